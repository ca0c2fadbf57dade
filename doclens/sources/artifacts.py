"""Artifacts and their parts: from directories, tables and archives; and the findings sink."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions.lens import lens

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files make far fewer partitions than there are; else df as it is.

    A file of one row group is one task. Inputs with enough splits are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() <= cores else df


def scan_artifacts(spark: SparkSession, path: str, glob: str = "*", max_length: int | None = None) -> DataFrame:
    """One row per file below path, with artifact_id (hash of the path) and lens text t.

    Files longer than max_length are not read: their row has no content, and says so in problem.
    For files of any size, see sources.ranges.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    if max_length is None:
        return as_artifacts(files)
    long = files.where(F.col("length") > max_length).drop("content").withColumn("content", F.lit(None).cast("binary"))
    whole = files.where(F.col("length") <= max_length).withColumn("problem", F.lit(None).cast("string"))
    return as_artifacts(whole.unionByName(long.withColumn("problem", F.lit("larger than max_length"))))


def as_artifacts(files: DataFrame) -> DataFrame:
    return files.withColumn("artifact_id", F.xxhash64("path")).withColumn("t", lens("content"))


def artifacts_from_table(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Artifacts from a text or binary column; text is taken as UTF-8 bytes."""
    binary = dict(df.dtypes)[value_col] == "binary"
    content = F.col(value_col) if binary else F.encode(F.col(value_col), "UTF-8")
    rows = df.select(F.col(id_col).alias("artifact_id"), content.alias("content"))
    return rows.withColumn("length", F.octet_length("content").cast("bigint")).withColumn("t", lens("content"))


#: Limits of what is unpacked: members of a container, and bytes of a member or stream.
MAX_PARTS, MAX_BYTES = 10_000, 64 << 20


#: Bytes of contents that a Python worker takes at a time, whole rows of them.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session of BATCH_BYTES rather than Spark's 64 MiB, of which a worker holds several copies. Another bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == f"{64 << 20}b":
        spark.conf.set(name, str(BATCH_BYTES))


def expand_archives(artifacts: DataFrame, max_parts: int = MAX_PARTS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """S3: the members of zip containers, one row each; a path that repeats is kept once.

    Members beyond max_parts or larger than max_bytes, and archives that cannot be read,
    come back as one row with the reason in problem and no content. Rows are dealt anew by
    artifact first, since a few large archives often come from one input split. artifact_id may
    be a number or a string.
    """
    bounded_batches(artifacts.sparkSession)
    by_text = dict(artifacts.dtypes)["artifact_id"] == "string"
    id_type = "string" if by_text else "bigint"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if by_text else pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string()]
        names = ["artifact_id", "ordinal", "part_path", "content", "problem"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, seen = [], 0, set()
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                        for k, info in enumerate(i for i in archive.infolist() if not i.is_dir()):
                            if info.filename in seen:
                                continue
                            seen.add(info.filename)
                            if len(seen) > max_parts:
                                rows.append((key, k, None, None, "more than max_parts members"))
                                break
                            if info.file_size > max_bytes:
                                rows.append((key, k, info.filename, None, "larger than max_bytes"))
                                continue
                            with archive.open(info) as member:
                                data = member.read(max_bytes + 1)
                            if len(data) > max_bytes:
                                rows.append((key, k, info.filename, None, "larger than max_bytes"))
                                continue
                            rows.append((key, k, info.filename, data, None))
                            size += len(data)
                            if size > 16 << 20:
                                yield batch_of(rows)
                                rows, size = [], 0
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, ValueError) as e:
                    rows.append((key, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield batch_of(rows)

    keyed = artifacts.select(F.col("artifact_id").cast(id_type).alias("artifact_id"), "content")
    schema = f"artifact_id {id_type}, ordinal int, part_path string, content binary, problem string"
    return keyed.repartition("artifact_id").mapInArrow(expand, schema)


def inflate(stream: Column, max_bytes: int = MAX_BYTES) -> Column:
    """(content, problem) of a zlib stream in a binary column; content is null where problem says why."""

    @F.arrow_udf("struct<content: binary, problem: string>")
    def run(streams: pa.Array) -> pa.Array:
        contents, problems = [], []
        for data in streams.to_pylist():
            value, problem = None, None if data else "no stream"
            if data:
                try:
                    machine = zlib.decompressobj()
                    value = machine.decompress(data, max_bytes)
                    if machine.unconsumed_tail or len(value) >= max_bytes and not machine.eof:
                        value, problem = None, "larger than max_bytes"
                    elif not machine.eof:
                        value, problem = None, "cut short"
                except zlib.error as e:
                    value, problem = None, f"damaged: {e}"
            contents.append(value)
            problems.append(problem)
        return pa.StructArray.from_arrays([pa.array(contents, pa.binary()), pa.array(problems, pa.string())], ["content", "problem"])

    return run(stream)


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as Parquet, one folder per severity."""
    findings.write.mode("overwrite").partitionBy("severity").parquet(path)
