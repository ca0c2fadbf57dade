"""From raw documents to packed training sequences: rules, exact and near dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.exact import exact_dedup, fresh_index
from doclens.llm.minhash import near_dedup
from doclens.llm.mixing import poisson_mix
from doclens.llm.packing import pack
from doclens.llm.quality import ROW, quality_rules
from doclens.llm.shared import documents, without, written

#: A hash of all of a row's columns: with the id, what tells rows apart that are not equal in everything.
NUMBER = "pipeline_row_hash"


def numbered(docs: DataFrame) -> DataFrame:
    docs = without(docs, (NUMBER,))
    return docs.withColumn(NUMBER, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))


def staying(rows: DataFrame, found: DataFrame, stays: str) -> DataFrame:
    """Numbered rows that stay by found (doc_id, row_no, and the boolean column stays), one of those equal in everything.

    The others' hashes are taken away by a sort-merge anti-join, at every size.
    """
    found = found.select(F.col("doc_id").alias("found_id"), F.col("row_no").alias("found_no"), F.col(stays).alias("stays"))

    def same(other: DataFrame) -> Column:
        return (rows[NUMBER] == other["found_no"]) & rows["doc_id"].eqNullSafe(other["found_id"])

    # Of rows equal in everything exact dedup keeps one and drops others, near dedup keeps all.
    keys = written(
        found.groupBy("found_id", "found_no").agg(F.count_if("stays").alias("n_stay"), F.count("*").alias("n")).where("n_stay = 0 or n > 1"),
        "dropped-rows",
    )
    kept = rows.join(keys.hint("merge"), same(keys), "left_anti")
    twins = keys.where("n_stay > 0")
    if not twins.isEmpty():
        kept = kept.unionByName(rows.join(twins.hint("merge"), same(twins), "left_semi").dropDuplicates())
    return kept.drop(NUMBER)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their host's verdict keep."""
    return quality_rules(docs, keep_rows=True).where("kept").select(f"{ROW}.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, blanks aside."""
    rows, index = numbered(docs), fresh_index(spark)
    found = exact_dedup(rows, index, row_col=NUMBER)
    index.close()
    return staying(rows, found, "kept")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: one with the smallest doc_id."""
    rows = numbered(docs)
    return staying(rows, near_dedup(rows, row_col=NUMBER), "stays")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out) by their source's Poisson rate, in a global random order."""
    return poisson_mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bins of at most the sequence length."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Near-duplicate classes are transitive closures over hashed candidates, and packing is a
#: sequential search, so SQL cannot express run(); tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next reads them."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
