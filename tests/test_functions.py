"""Byte lens and artifact columns."""

import zlib

from pyspark.sql import functions as F

from doclens.functions import artifact_columns as columns
from doclens.functions.lens import lens, offsets_of, u16, u32, unhexed, unlens
from doclens.sources import artifacts as sources


def test_lens_round_trip_and_numbers(spark):
    every = bytes(range(256))
    df = spark.createDataFrame([(every,)], "content binary").withColumn("t", lens("content"))
    row = df.select(unlens("t").alias("c"), F.length("t").alias("n"), u16(F.col("t"), 254).alias("a"), u32(F.col("t"), 1).alias("b"), u16(F.col("t"), 255).alias("none")).first()
    assert (bytes(row.c), row.n, row.a, row.b, row.none) == (every, 256, 0xFFFE, 0x04030201, None)


def test_unhexed_refuses_odd_and_foreign_digits(spark):
    df = spark.createDataFrame([("abcd",), ("abc",), ("zz",), ("",), (None,)], "h string")
    assert [r.x and bytes(r.x) for r in df.select(unhexed(F.col("h")).alias("x")).collect()] == [b"\xab\xcd", None, None, None, None]


def test_offsets_of_repeated_records(spark):
    df = spark.createDataFrame([("ab..ab..ab",), ("none",)], "t string")
    places = df.select(offsets_of(F.regexp_extract_all("t", F.lit("ab"), F.lit(0)), F.col("t"), 2).alias("p")).collect()
    assert [r.p for r in places] == [[0, 4, 8], []]


def test_magic_and_host(spark):
    ole = bytes.fromhex("D0CF11E0A1B11AE1")
    rows = [(ole + b"Microsoft Excel",), (ole + b"Word.Document",), (b"PK\x03\x04x",), (b"{\\rtf1",), (b"%PDF-1",), (b"",), (None,)]
    df = columns.classify_host_app(columns.classify_magic(spark.createDataFrame(rows, "content binary")))
    assert [(r.kind, r.host_app) for r in df.collect()] == [("ole", "excel"), ("ole", "word"), ("ooxml", None), ("rtf", None), ("pdf", None), (None, None), (None, None)]


def test_inflate(spark):
    rows = [(zlib.compress(b"hello"),), (zlib.compress(b"hello")[:-3],), (b"junk",), (None,)]
    df = spark.createDataFrame(rows, "s binary").select(sources.inflate(F.col("s")).alias("x"))
    assert [(r.x.content and bytes(r.x.content), (r.x.problem or "")[:9]) for r in df.collect()] == [(b"hello", ""), (None, "cut short"), (None, "damaged: "), (None, "no stream")]
    long = spark.createDataFrame([(zlib.compress(b"a" * 100),), (zlib.compress(b"a" * 10),)], "s binary").select(sources.inflate(F.col("s"), 10).alias("x"))
    assert [(r.x.content and bytes(r.x.content), r.x.problem) for r in long.collect()] == [(None, "larger than max_bytes"), (b"a" * 10, None)]
