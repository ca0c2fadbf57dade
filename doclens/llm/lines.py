"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.shared import ascii_lower, documents, new_path, written

MIN_POINTS = 40
MIN_DOCS = 5
#: Batches in which one table is fed to the runs, newest ids first.
BATCHES = 4
#: Runs of a level that are merged into one of the next.
FANOUT = 3
#: Blank characters that a line's key does without at both ends.
BLANK_CHARS = " \t\n\x0b\x0c\r"

RUN_SCHEMA = "line_key BINARY, n_docs BIGINT, keep_id BIGINT"
MANIFEST_SCHEMA = "seq BIGINT, run STRING, level INT, batch STRING, replaces ARRAY<STRING>"


class LineRuns:
    """Line hashes already seen, as Parquet runs bucketed and sorted by hash, in levels.

    A run has a row for each hash: the documents of its batch that hold the line, and, in the
    run that saw it first, the id that keeps it (null in all others). FANOUT runs of a level are
    merged into one of the next, so a hash meets about FANOUT runs a level. The manifest, a small
    table beside the runs, says which runs count: a run whose write broke off is not in it, and
    a batch that it names is not added again, so a job may be repeated after any failure. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, fanout: int = FANOUT):
        self.spark, self.path, self.buckets, self.fanout = spark, path, buckets, fanout
        self.tables: dict[str, str] = {}
        self.entries: list = []
        self._manifest([])

    def _manifest(self, rows: list[tuple]) -> None:
        frame = self.spark.createDataFrame(rows, MANIFEST_SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.entries = self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.path}/manifest").orderBy("seq").collect()

    def live(self) -> list:
        """Manifest entries (level, run) of the runs that no later run replaces, oldest first."""
        replaced = {name for e in self.entries for name in e["replaces"]}
        return [e for e in self.entries if e["run"] not in replaced]

    def run(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {self.tables[name]} ({RUN_SCHEMA}) USING parquet CLUSTERED BY (line_key) SORTED BY (line_key) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
        return self.spark.table(self.tables[name])

    def _write(self, rows: DataFrame, level: int, batch: str | None, replaces: list[str]) -> None:
        name = f"run-{uuid.uuid4().hex}"
        self.run(name)
        (
            rows.select("line_key", "n_docs", "keep_id")
            .repartition(self.buckets, "line_key")
            .write.bucketBy(self.buckets, "line_key")
            .sortBy("line_key")
            .mode("append")
            .format("parquet")
            .option("path", f"{self.path}/{name}")
            .saveAsTable(self.tables[name])
        )
        self.spark.catalog.refreshTable(self.tables[name])
        self._manifest([(len(self.entries), name, level, batch, replaces)])

    def add(self, keys: DataFrame, batch: str) -> None:
        """Add a batch (line_key, n_docs, keep_id; a row for each key) as a run of level 0.

        Keys that no run has keep the batch's id; of the others only the count is added.
        """
        if any(e["batch"] == batch for e in self.entries):
            return
        keys = written(keys.select("line_key", "n_docs", "keep_id"), "line-batch")
        unseen = keys
        for e in self.live():
            unseen = unseen.join(self.run(e["run"]).select("line_key").hint("merge"), "line_key", "left_anti")
        unseen = written(unseen, "unseen-lines")
        seen = keys.join(unseen.select("line_key").hint("merge"), "line_key", "left_anti")
        self._write(unseen.unionByName(seen.withColumn("keep_id", F.lit(None).cast("bigint"))), 0, batch, [])
        self.compact()

    def compact(self) -> None:
        """Merge the runs of every level that has FANOUT of them into one of the next level."""
        level = 0
        while any(e["level"] >= level for e in self.live()):
            full = [e["run"] for e in self.live() if e["level"] == level]
            if len(full) >= self.fanout:
                self._write(self._merged(full), level + 1, None, full)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        # As plain files: a union of bucketed tables claims their partitioning, also where it does not read by bucket.
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/{n}") for n in names])
        return rows.groupBy("line_key").agg(F.sum("n_docs").alias("n_docs"), F.max("keep_id").alias("keep_id"))

    def merged(self) -> DataFrame:
        """(line_key, n_docs, keep_id) over all runs, a row for each key."""
        names = [e["run"] for e in self.live()]
        return self._merged(names) if names else self.spark.createDataFrame([], RUN_SCHEMA)

    def close(self) -> None:
        """Forget the runs' names in the catalog; the files stay."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = {}


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANK_CHARS)))


def line_keys(docs: DataFrame, min_points: int = MIN_POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, pos, line_key, is_first): every line whose key has min_points code points.

    line_key is the MD5 of the key, pos counts lines from 0, is_first marks a key's first line of its document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = F.transform(F.split(text, "\n"), lambda line, i: F.struct(line_key(line).alias("k"), i.alias("i")))
    long_keys = F.transform(
        F.filter(keys, lambda x: F.length(x["k"]) >= min_points),
        lambda x: F.struct(F.unhex(F.md5(x["k"])).alias("k"), x["i"].alias("i")),
    )
    # A generator between the steps keeps the optimizer from copying the arrays into every use of them.
    found = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.explode(F.array(F.array_sort(long_keys))).alias("keys"))
    marked = F.transform(
        "keys", lambda x, j: F.struct(x["i"].alias("pos"), x["k"].alias("line_key"), ((j == 0) | (F.get("keys", j - 1)["k"] != x["k"])).alias("is_first"))
    )
    return found.select("doc_id", "text_hash", F.explode(marked).alias("x")).select("doc_id", "text_hash", "x.*")


def line_dedup(
    docs: DataFrame,
    runs: LineRuns,
    batch: str,
    batches: int = BATCHES,
    min_points: int = MIN_POINTS,
    min_docs: int = MIN_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): documents without lines that others hold too.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least
    min_points code points that min_docs documents hold, those of earlier batches counted, lose
    their lines in all documents but one: the one that keeps it by an earlier batch, else the
    largest id. docs go to the runs in stretches of ids, the largest first, so what a stretch's
    anti-join leaves is held by no larger id. One row per input row. Null or empty text is one
    empty line; rows that repeat an id count as documents each and keep the same lines; null ids
    count as the smallest; other columns are left out. Empty input gives an empty result.
    """
    spark = docs.sparkSession
    ends = docs.agg(F.min(id_col).alias("least"), F.max(id_col).alias("most")).first()
    least, most = (ends["least"], ends["most"]) if ends["most"] is not None else (0, 0)
    stretch = F.floor((F.lit(float(most)) - F.col("doc_id").cast("double")) * batches / float(most - least + 1))
    stretch = F.when(F.col("doc_id").isNull(), batches - 1).otherwise(F.least(F.greatest(stretch, F.lit(0)), F.lit(batches - 1))).cast("int")
    path = new_path(spark, "line-keys")
    keyed = line_keys(docs, min_points, id_col, text_col)
    keyed.withColumn("stretch", stretch).write.partitionBy("stretch").parquet(path)
    keyed = spark.read.schema(f"{_ddl(keyed)}, stretch INT").parquet(path)
    for k in range(batches):
        # A key that very many documents hold is combined before the shuffle.
        own = keyed.where((F.col("stretch") == k) & F.col("is_first"))
        runs.add(own.groupBy("line_key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_id")), f"{batch}/{k}")
    frequent = written(runs.merged().where(F.col("n_docs") >= min_docs).select("line_key", "keep_id"), "frequent-lines")
    # Both sides come straight from tables, so Spark may split the shuffle partition of a hot line.
    lost = keyed.join(frequent.hint("merge"), "line_key").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    lost = lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash")).agg(F.collect_set("pos").alias("lost"))
    lost = written(lost, "lost-lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    joined = rows.join(lost.hint("merge"), rows["doc_id"].eqNullSafe(lost["lost_id"]) & (rows["text_hash"] == lost["lost_hash"]), "left")
    split = joined.select("doc_id", "text", F.coalesce("lost", F.array().cast("array<int>")).alias("lost"), F.explode(F.array(F.split("text", "\n"))).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.size("lost") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return split.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.size("lost").cast("bigint").alias("n_dropped"), kept.alias("kept_text"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def fresh_runs(spark: SparkSession, buckets: int | None = None) -> LineRuns:
    """Runs at a new path, with as many buckets as the session has shuffle partitions unless given."""
    return LineRuns(spark, new_path(spark, "line-runs"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = fresh_runs(spark)
    found = line_dedup(documents(spark, sf_dir), runs, "documents")
    runs.close()
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM d)),
f AS (SELECT k, max(doc_id) AS keep_id FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, keep_id IS NOT NULL AND doc_id <> keep_id AS lost FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
