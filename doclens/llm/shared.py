"""What the operators share: word expressions, and tables written between jobs (doclens.sources.tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.sources.artifacts import spread
from doclens.sources.tables import new_path, written

__all__ = ["BLANKS", "ascii_lower", "documents", "new_path", "without", "words_of", "written"]

#: Blank characters of the word contracts, as a class for Java, RE2 and Python regexes.
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: str | Column) -> Column:
    """Array of the maximal runs of non-blank characters; null text has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(column, F.lit("")), BLANKS), lambda w: w != F.lit(""))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else; pure ASCII takes the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def without(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df without columns of these names, which the operator makes itself (case does not count)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
