"""Carving (G1 to G17): strings, blobs, objects and records out of lens text, one row each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions.lens import byte_at, offsets_of, u16, u32, unhexed

MIN_BLOB = 200
ASCII_RUN = r"[\x20-\x7e]{10,1000}"
WIDE_RUN = r"(?:[\x20-\x7e]\x00){5,}"
PRINTABLE_RUN = r"[\x20-\x7e\t\n\r\x0b\x0c]{7,}"
BASE64_RUN = r"(?:[A-Za-z0-9+/]{4}){13,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"
PDF_OBJECT = r"\d+ \d+ obj[\x00-\xff]*?endobj"
RTF_OLE = r"(d0cf11e[\x00-\x66]+)\}"
#: Hex blobs in RTF text, blanks among them: after a control word, its number and the blank that ends it, or after a brace.
RTF_BLOB = r"(?:\\[a-z]+(?:-?\d+)?[ \t\r\n]|[}{])([0-9a-fA-F \t\r\n]{100,})"
RTF_AUX = r"[A-Za-z]\}?((?:[0-9a-fA-F]{2}){50,})(?:\{|\\|\})"
FUNCTION_NAME = r"Function [A-Za-z0-9_]{3,20}"
# Record marks of the legacy workbook format.
BOF = r"\x09\x08[\x00-\xff]{2}\x00[\x05\x06][\x05\x10\x40]\x00[\x00-\xff]{4}"
BOUNDSHEET = r"\x85\x00[\x00-\xff]{2}[\x00-\xff]{4}[\x00-\x03][\x00\x01]"
EOF_MARK = "\x0a\x00\x00\x00"
OLE_MAGIC = "D0CF11E0A1B11AE1"


def all_matches(t: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))


def _strings(df: DataFrame, kind: str, matches: Column) -> DataFrame:
    path = F.col("part_path") if "part_path" in df.columns else F.lit("")
    return df.select("artifact_id", path.alias("part_path"), F.lit(kind).alias("kind"), F.posexplode(matches).alias("pos", "value"))


def carve_ascii(df: DataFrame) -> DataFrame:
    """G1: runs of 10 to 1000 printable ASCII characters."""
    return _strings(df, "ascii", all_matches(F.col("t"), ASCII_RUN))


def carve_wide(df: DataFrame) -> DataFrame:
    """Runs of five or more UTF-16LE ASCII characters, without their zero bytes."""
    return _strings(df, "wide", F.transform(all_matches(F.col("t"), WIDE_RUN), lambda x: F.replace(x, F.lit("\x00"), F.lit(""))))


def carve_printable(df: DataFrame) -> DataFrame:
    """Runs of seven or more printable characters, as the strings tool finds them."""
    return _strings(df, "printable", all_matches(F.col("t"), PRINTABLE_RUN))


def carve_base64(df: DataFrame, value: str = "t") -> DataFrame:
    """base64 runs of more than 50 characters that decode."""
    found = _strings(df.withColumn("t", F.col(value)), "base64", all_matches(F.col(value), BASE64_RUN))
    return found.where((F.length("value") > 50) & F.expr("try_to_binary(value, 'base64')").isNotNull())


def carve_strings(df: DataFrame) -> DataFrame:
    """All kinds of strings."""
    return carve_ascii(df).unionByName(carve_wide(df)).unionByName(carve_printable(df))


# Streams whose strings are left out.
SKIPPED_PARTS = ("CompObj", "Summary")


def carved_parts(parts: DataFrame) -> DataFrame:
    """parts whose strings are carved: not the ones named CompObj or Summary."""
    skipped = F.contains("part_path", F.lit(SKIPPED_PARTS[0])) | F.contains("part_path", F.lit(SKIPPED_PARTS[1]))
    return parts.where(~F.coalesce(skipped, F.lit(False)))


def scannable(strings: DataFrame) -> DataFrame:
    """strings long enough for rules: more than 15 characters if printable, else more than 8."""
    return strings.where(F.length("value") > F.when(F.col("kind") == "printable", 15).otherwise(8))


def rtf_clean_hex(t: Column) -> Column:
    """Without line ends, tabs and spaces."""
    return F.translate(t, "\r\n\t ", "")


def _blobs(df: DataFrame, pattern: str) -> DataFrame:
    found = df.select("artifact_id", F.posexplode(all_matches(rtf_clean_hex(F.col("t")), pattern, 1)).alias("pos", "hex"))
    return found.where(F.length("hex") > MIN_BLOB)  # F1


def carve_rtf_ole(df: DataFrame) -> DataFrame:
    """Hex of OLE files in RTF, with the decoded content (null where the hex is damaged)."""
    return _blobs(df, RTF_OLE).withColumn("content", unhexed(F.col("hex")))


def carve_rtf_blobs(df: DataFrame) -> DataFrame:
    """Hex blobs after a control word or brace, whole bytes from their first digit on.

    Control words are found before blanks are deleted (G5): a word ends at its blank, so digits
    after it belong to the blob.
    """
    found = df.select("artifact_id", F.posexplode(all_matches(F.col("t"), RTF_BLOB, 1)).alias("pos", "run"))
    digits = found.select("artifact_id", "pos", rtf_clean_hex(F.col("run")).alias("digits"))
    whole = F.expr("left(digits, length(digits) - length(digits) % 2)")
    return digits.select("artifact_id", "pos", whole.alias("hex")).where(F.length("hex") > MIN_BLOB).withColumn("content", unhexed(F.col("hex")))


def carve_rtf_aux(df: DataFrame) -> DataFrame:
    """The fallback pattern, for artifacts without a blob of the first one."""
    carved = carve_rtf_blobs(df).select("artifact_id").distinct()
    return _blobs(df.join(carved, "artifact_id", "left_anti"), RTF_AUX).withColumn("content", unhexed(F.col("hex")))


def carve_hex_ole(df: DataFrame) -> DataFrame:
    """From the first hex OLE magic of the cleaned text on, as far as hex digits go."""
    hex_tail = F.regexp_extract(rtf_clean_hex(F.col("t")), f"({OLE_MAGIC.lower()}(?:[0-9a-f]{{2}})*)", 1)
    return df.select("artifact_id", hex_tail.alias("hex")).where("hex <> ''").withColumn("content", unhexed(F.col("hex")))


def carve_embedded_ole(parts: DataFrame) -> DataFrame:
    """From every OLE magic inside a part (not at its start) to the part's end."""
    t = F.col("t")
    places = offsets_of(all_matches(t, "\\x" + "\\x".join(re.findall("..", OLE_MAGIC))), t, 8)
    inner = parts.select("artifact_id", "t", F.explode(F.filter(places, lambda p: p > 0)).alias("offset"))
    return inner.select("artifact_id", "offset", F.expr("substring(t, cast(offset AS INT) + 1)").alias("t"))


def carve_pdf_objects(df: DataFrame) -> DataFrame:
    """PDF objects in order, with number, header and body."""
    found = df.select("artifact_id", F.posexplode(all_matches(F.col("t"), PDF_OBJECT)).alias("ordinal", "body"))
    return found.select(
        "artifact_id",
        "ordinal",
        F.expr(r"try_cast(regexp_extract(body, '^([0-9]+) ', 1) AS BIGINT)").alias("obj_no"),
        F.regexp_extract("body", r"^(\d+ \d+ obj\s?<<[\x00-\xff]*?>>)", 1).alias("header"),
        "body",
    )


def decode_pdf_ascii_hex(objects: DataFrame) -> DataFrame:
    """Decoded hex streams of objects that name an ASCIIHex filter, and whether they hold RTF."""
    wanted = objects.where(F.contains("body", F.lit("ASCIIHexDecode")) | F.contains("body", F.lit("ASCII85HexDecode")))
    clean = F.regexp_replace("body", "[ \\r\\n]", "")
    digits = F.regexp_extract(clean, r"stream((?:[0-9a-fA-F]{2})+)", 1)
    return wanted.select("artifact_id", "ordinal", "obj_no", F.when(digits != "", F.lower(digits)).alias("hex")).where(
        "hex is not null"
    ).withColumn("content", unhexed(F.col("hex"))).withColumn("has_rtf", F.contains("content", F.lit(b"\\rt")))


def carve_bof(df: DataFrame) -> DataFrame:
    """BOF records with offset, length, version and substream, also where equal records repeat."""
    t = F.col("t")
    found = df.withColumn("m", all_matches(t, BOF)).withColumn("offset", F.explode(offsets_of(F.col("m"), t, 12)))
    version, kind = byte_at(t, F.col("offset") + 5), byte_at(t, F.col("offset") + 6)
    return found.select(
        "artifact_id",
        "offset",
        u16(t, F.col("offset") + 2).alias("rec_len"),
        F.when(version == 5, "5/7").when(version == 6, "8").alias("biff"),
        F.when(kind == 5, "globals").when(kind == 16, "worksheet").when(kind == 64, "xlm").alias("substream"),
    )


def carve_eof(df: DataFrame) -> DataFrame:
    """Offsets of the end-of-substream marks."""
    t = F.col("t")
    return df.select("artifact_id", F.explode(offsets_of(all_matches(t, r"\x0a\x00\x00\x00"), t, 4)).alias("offset"))


def carve_boundsheets(df: DataFrame) -> DataFrame:
    """BOUNDSHEET records in order, with visibility, macro flag and printable name."""
    t = F.col("t")
    places = offsets_of(all_matches(t, BOUNDSHEET), t, 10)
    found = df.withColumn("p", places).select("artifact_id", "t", F.posexplode("p").alias("sheet_no", "offset"))
    hidden = byte_at(t, F.col("offset") + 8).bitwiseAND(F.lit(3).cast("bigint"))
    return found.select(
        "artifact_id",
        (F.col("sheet_no") + 1).cast("bigint").alias("sheet_no"),
        F.col("offset").alias("record_offset"),
        u32(t, F.col("offset") + 4).alias("bof_offset"),
        F.when(hidden == 0, "visible").when(hidden == 1, "hidden").when(hidden == 2, "very hidden").alias("visibility"),
        (byte_at(t, F.col("offset") + 9) == 1).alias("xlm"),
        sheet_name(t, F.col("offset")).alias("sheet_name"),
    )


def sheet_name(t: Column, offset: Column) -> Column:
    """What is printable of the name after a record: its number of characters, a flag for two bytes each, then they."""
    wide = byte_at(t, offset + 11).bitwiseAND(F.lit(1).cast("bigint"))
    name = F.substring(t, offset + 13, byte_at(t, offset + 10) * (wide + 1))
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\x20-\x7e]", "")


def valid_sheets(sheets: DataFrame, lengths: DataFrame) -> DataFrame:
    """sheets with an allowed name, whose BOF lies between byte 512 and the artifact's end."""
    joined = sheets.join(lengths, "artifact_id")
    return joined.where(~F.col("sheet_name").rlike(r"[\\/?*\[\]]") & F.col("bof_at").between(512, F.col("length"))).drop("length")


def carve_functions(df: DataFrame) -> DataFrame:
    """Names of script functions, of texts that hold Function or Sub."""
    coded = df.where(F.contains("t", F.lit("Function")) | F.contains("t", F.lit("Sub ")))
    return coded.select("artifact_id", F.posexplode(all_matches(F.col("t"), FUNCTION_NAME)).alias("pos", "value"))
