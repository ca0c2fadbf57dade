"""Columns of an artifact or part: fingerprints, kinds, headers and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions.lens import text_of, u16

# The magic bytes of the four file kinds, in the order they are tried.
MAGIC = [("ole", "D0CF11E0A1B11AE1"), ("ooxml", "504B0304"), ("rtf", "7B5C7274"), ("pdf", "255044462D")]
# Byte strings that name the host application of an OLE file.
HOST_APPS = [("excel", ["Microsoft Excel"]), ("word", ["Microsoft Office Word", "Word.Document"])]
# Folders of an Office container, by document type.
DOC_TYPES = [("word", "word/"), ("excel", "xl/"), ("ppt", "ppt/")]
#: Characters, or items, of a description that reports keep, by what it describes.
CLIP = {"vba": 100, "xlm": 150, "string": 1000, "pdf_object": 1000}
CLIP_ITEMS = {"base64": 20, "payload": 100}


def with_sha256(df: DataFrame) -> DataFrame:
    """sha256 of content, in hex."""
    return df.withColumn("sha256", F.sha2("content", 256))


def magic_kind(content: Column) -> Column:
    """Ole, ooxml, rtf, pdf or null, by the first bytes of a binary column."""
    kind = F.lit(None).cast("string")
    for name, magic in reversed(MAGIC):
        kind = F.when(F.startswith(content, F.lit(bytes.fromhex(magic))), F.lit(name)).otherwise(kind)
    return kind


def lens_kind(t: Column) -> Column:
    """P2 on lens text."""
    kind = F.lit(None).cast("string")
    for name, magic in reversed(MAGIC):
        kind = F.when(F.startswith(t, text_of(magic)), F.lit(name)).otherwise(kind)
    return kind


def classify_magic(df: DataFrame) -> DataFrame:
    return df.withColumn("kind", magic_kind(F.col("content")))


def classify_host_app(df: DataFrame) -> DataFrame:
    """Excel or word for OLE files that name their application; null otherwise."""
    app = F.lit(None).cast("string")
    for name, needles in reversed(HOST_APPS):
        held = F.lit(False)
        for needle in needles:
            held = held | F.contains("content", F.lit(needle.encode()))
        app = F.when(held, F.lit(name)).otherwise(app)
    return df.withColumn("host_app", F.when(magic_kind(F.col("content")) == "ole", app))


def part_type(path: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, folder in DOC_TYPES:  # the later type wins within a path
        kind = F.when(F.contains(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(folder)), F.lit(name)).otherwise(kind)
    return kind


def ooxml_doc_type(parts: DataFrame) -> DataFrame:
    """(artifact_id, doc_type): the type of the last member that has one."""
    typed = parts.withColumn("doc_type", part_type(F.col("part_path"))).where("doc_type is not null")
    return typed.groupBy("artifact_id").agg(F.max_by("doc_type", "ordinal").alias("doc_type"))


def cfb_header(df: DataFrame) -> DataFrame:
    """P5: version, sector and ministream sizes of OLE headers, from lens text t."""
    t, shift = F.col("t"), u16(F.col("t"), 30)
    return df.where(lens_kind(t) == "ole").select(
        "artifact_id",
        u16(t, 24).alias("minor_version"),
        u16(t, 26).alias("major_version"),
        u16(t, 28).alias("byte_order"),
        F.when(shift == 9, 512).when(shift == 12, 4096).cast("bigint").alias("sector_size"),
        F.when(shift == 9, 480).when(shift == 12, 4064).cast("bigint").alias("payload_size"),
        (u16(t, 26) == 3).alias("version_3"),
    )


def clean_part_name(path: Column) -> Column:
    """A stream path without control marks at its names' ends, its names joined by backslashes."""
    names = F.transform(F.split(path, "/"), lambda n: F.regexp_replace(n, "^\x01+|\x01+$", ""))
    return F.array_join(names, "\\")


def clip_description(description: Column, about: str) -> Column:
    """The description as far as reports show it."""
    return F.left(description, F.lit(CLIP[about])) if about in CLIP else F.slice(description, 1, CLIP_ITEMS[about])


def printable_preview(t: Column, n: int = 1000) -> Column:
    """The first n characters, dots for what cannot be shown."""
    return F.regexp_replace(F.left(t, F.lit(n)), "[^\\x20-\\x7e\\n]", ".")


def hex_preview(content: Column, n: int = 16) -> Column:
    return F.hex(F.substring(content, 1, n))
