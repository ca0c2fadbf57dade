"""Exact dedup against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.shared import BLANKS, documents, new_path, written

DIGEST = "text_sha256"
INDEX_SCHEMA = f"{DIGEST} STRING, keep_id BIGINT, n_code_points BIGINT, batch STRING"


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row_no, doc_id, n_code_points, text_sha256): SHA-256 of the text without its blanks.

    row_no is row_col, or else a number that the row gets here. A null text counts as empty.
    Repeated rows stay repeated; other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_no"),
        F.col(id_col).alias("doc_id"),
        F.length(text).cast("bigint").alias("n_code_points"),
        F.sha2(F.regexp_replace(text, BLANKS, ""), 256).alias(DIGEST),
    )


class DigestIndex:
    """Digests already seen, as a Parquet table bucketed and sorted by digest at a lasting path.

    The files are the index; any session opens them again by path, and joins on the
    digest then read the buckets in order, without a shuffle of the index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """Rows of digests that the index lacks, by a sort-merge anti-join."""
        return digests.join(self.rows().select(DIGEST).hint("merge"), DIGEST, "left_anti")

    def close(self) -> None:
        """Forget the table's name in the catalog; the files stay the index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def compacted(self, path: str) -> DigestIndex:
        """The same index at a new path, with one sorted file a bucket again after many appends."""
        other = DigestIndex(self.spark, path, self.buckets)
        other.append(self.rows())
        return other

    def append(self, keepers: DataFrame) -> None:
        """Add (text_sha256, keep_id, n_code_points, batch) rows whose digests are new; each digest at most once."""
        (
            self.unseen(keepers)
            .select(DIGEST, "keep_id", "n_code_points", "batch")
            .repartition(self.buckets, DIGEST)
            .write.bucketBy(self.buckets, DIGEST)
            .sortBy(DIGEST)
            .mode("append")
            .format("parquet")
            .option("path", self.path)
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)


def exact_dedup(
    docs: DataFrame,
    index: DigestIndex,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Deduplicate docs against themselves and the index, then append what is new to it.

    Returns one row per input row: doc_id, keep_id, group_size (rows of docs with this
    text), kept, text_sha256. Of equal texts the row with the most code points stays, then
    the smallest id (null ids last); a text that the index had before keeps its earlier
    keep_id and no row of docs is kept. Of rows that tie in all this, ids included, one
    stays: that with the smallest row_col, a number that tells rows apart, if given (all with
    that number do). Then the result has it as row_no. Empty input gives an empty result.

    batch names the input in the index. What the index has from the same batch is not counted
    as seen before, so a job that failed after the append may run again with the same rows and
    the same name, and gets the same result. Without a name each call is a batch of its own.
    """
    batch = batch or uuid.uuid4().hex
    digests = written(with_digest(docs, id_col, text_col, row_col), "digests")
    order = F.struct(-F.col("n_code_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_no"))
    groups = written(
        digests.groupBy(DIGEST)
        .agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
        .select(
            DIGEST,
            "group_size",
            F.col("first.doc_id").alias("best_id"),
            F.col("first.row_no").alias("best_row"),
            (-F.col("first.col1")).alias("n_code_points"),
        ),
        "groups",
    )
    # One row per digest: no digest is hot here, however often its text occurs.
    earlier = index.rows().where(~F.col("batch").eqNullSafe(F.lit(batch)))
    known = earlier.select(DIGEST, F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
    verdicts = written(
        groups.join(known.hint("merge"), DIGEST, "left").select(
            DIGEST,
            "group_size",
            "best_row",
            F.coalesce("known", F.lit(False)).alias("known"),
            F.when(F.col("known"), F.col("known_id")).otherwise(F.col("best_id")).alias("keep_id"),
        ),
        "verdicts",
    )
    index.append(groups.select(DIGEST, F.col("best_id").alias("keep_id"), "n_code_points", F.lit(batch).alias("batch")))
    # Both sides come straight from tables, so Spark may split the shuffle partition of a hot text.
    return digests.join(verdicts, DIGEST).select(
        "doc_id",
        "keep_id",
        "group_size",
        (~F.col("known") & (F.col("row_no") == F.col("best_row"))).alias("kept"),
        DIGEST,
        *(["row_no"] if row_col else []),
    )


def fresh_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    return DigestIndex(spark, new_path(spark, "digest-index"), buckets)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fresh_index(spark)
    found = exact_dedup(documents(spark, sf_dir), index)
    index.close()
    return found


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
