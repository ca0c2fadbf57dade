"""Triage of files as they arrive: the batch operators on a stream of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclens.operators import triage
from doclens.sources.artifacts import BINARY_FILE, as_artifacts
from doclens.sources.tables import temporary_tables


def artifact_stream(spark: SparkSession, path: str, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return as_artifacts(files)


def stream_findings(artifacts: DataFrame) -> DataFrame:
    """String findings with the file's time; carving and rules keep no state."""
    kept = artifacts.select("artifact_id", "t", "modificationTime")
    strings = kept.select("modificationTime", "artifact_id", F.posexplode(F.regexp_extract_all("t", F.lit(triage.carve.ASCII_RUN), F.lit(0))).alias("pos", "value"))
    return triage.rules.apply_rules(strings)


def dedup_stream(findings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of equal (artifact, description) findings within the delay.

    Until there is a watermark Spark takes the epoch for it, and drops what is not after it: rows of the epoch or before count as just after.
    """
    time, first = F.col("modificationTime"), F.timestamp_millis(F.lit(1))
    timed = findings.withColumn("event_time", F.when(time < first, first).otherwise(time)).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["artifact_id", "description"]).drop("event_time")


def findings_per_window(findings: DataFrame, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Findings by rule and time window; later rows than the delay are dropped."""
    timed = findings.withWatermark("modificationTime", delay) if findings.isStreaming else findings
    counted = timed.groupBy(F.window("modificationTime", length).alias("w"), "rule_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "rule_id", "n")


def triage_stream(spark: SparkSession, path: str, out: str, checkpoint: str, dedup: bool = True) -> StreamingQuery:
    """Runs over the files present and ends: findings as Parquet below out."""
    found = stream_findings(artifact_stream(spark, path))
    if dedup:
        found = dedup_stream(found)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def triage_all_stream(artifacts: DataFrame, out: str, checkpoint: str, max_depth: int | None = None) -> StreamingQuery:
    """All families on a stream of artifacts, over what is present: each batch's findings as Parquet below out.

    A batch is triaged as a table is (triage_all); a batch that runs again replaces its folder.
    The tables between its jobs are removed when its output is written.
    """

    def each(batch: DataFrame, number: int) -> None:
        with temporary_tables(batch.sparkSession):
            found = triage.triage_all(batch.select("artifact_id", "t"), max_depth)
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return artifacts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
