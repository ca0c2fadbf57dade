"""Every registered query: name -> (spark, sf_dir) -> DataFrame, and its checking SQL for DuckDB."""

from __future__ import annotations

import io
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions import artifact_columns as columns
from doclens.functions.lens import lens, unlens
from doclens.operators import biff, carve, findings, ooxml, pdf, rollups, rules, signatures, sketches, triage
from doclens.plans import expected, fixtures
from doclens.plans.fixtures import cte, table
from doclens.sources import artifacts as sources
from doclens.sources import ranges as range_source
from doclens.sources.tables import new_path, written
from doclens.streaming import state, stream

FLAGSHIP = "flagship_top_risky"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    """documents as artifacts of text (every character of these is taken as one)."""
    rows = sources.spread(spark.read.parquet(f"{d}/documents.parquet"))
    return rows.select(F.col("doc_id").alias("artifact_id"), F.coalesce("text", F.lit("")).alias("t"))


def longs(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, as DuckDB returns them."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


# --- SQL pieces ---

DOCS = "docs AS (SELECT doc_id AS artifact_id, coalesce(text, '') AS t FROM documents)"
OLE = fixtures.OLE


def every(source: str, pattern: str, group: int = 0, keep: str = "artifact_id") -> str:
    """DuckDB: (keep, pos, value) of all matches in t."""
    return (
        f"(SELECT {keep}, unnest(range(len(m))) AS pos, unnest(m) AS value FROM "
        f"(SELECT *, regexp_extract_all(t, '{pattern}', {group}) AS m FROM {source}))"
    )


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\x00", "'||chr(0)||'") + "'"


def rule_sql(rule: rules.Rule, v: str) -> str:
    any_in = [f"contains({v}, {quoted(x)})" for x in rule.includes]
    if rule.regex:
        any_in.append(f"regexp_matches({v}, {quoted(rule.regex)})")
    sql = "(" + " OR ".join(any_in) + ")"
    if rule.excludes:
        sql += " AND NOT (" + " OR ".join(f"contains({v}, {quoted(x)})" for x in rule.excludes) + ")"
    if rule.max_len is not None:
        sql += f" AND length({v}) < {rule.max_len}"
    return sql


def rules_sql(source: str, keep: str, rule_list: list[rules.Rule], v: str = "value", described: dict[str, str] | None = None) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, '{r.indication}' AS indication, {(described or {}).get(r.rule_id, v)} AS description "
        f"FROM {source} WHERE {rule_sql(r, v)}"
        for r in rule_list
    )


MAGIC_SQL = (
    f"CASE WHEN starts_with(t, {OLE}) THEN 'ole' WHEN starts_with(t, 'PK'||chr(3)||chr(4)) THEN 'ooxml' "
    "WHEN starts_with(t, '{'||chr(92)||'rt') THEN 'rtf' WHEN starts_with(t, '%PDF-') THEN 'pdf' END"
)

# --- sources and columns ---


@query("SELECT doc_id AS artifact_id, strlen(text)::BIGINT AS length, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def s2_p1_artifacts_from_table(spark, d):
    found = sources.artifacts_from_table(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")
    return columns.with_sha256(found.where("content is not null")).select("artifact_id", "length", "sha256")


@query("SELECT doc_id AS artifact_id, 'doc/' || lang || '.txt' AS part_path, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def s3_expand_archives(spark, d):
    """Zips every document with its language as the name, then expands the archives."""

    @F.arrow_udf("binary")
    def zipped(names: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for name, text in zip(names.to_pylist(), texts.to_pylist(), strict=True):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"doc/{name}.txt", text)
            out.append(buffer.getvalue())
        return pa.array(out, pa.binary())

    rows = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    packed = rows.select(F.col("doc_id").alias("artifact_id"), zipped("lang", "text").alias("content"))
    return sources.expand_archives(packed).select("artifact_id", "part_path", F.sha2("content", 256).alias("sha256"))


def _range_sql() -> str:
    """Strings by kind over all texts, each ended by a byte that no string holds."""
    kinds = (("ascii", expected.ASCII_RUN), ("printable", expected.PRINTABLE_RUN), ("base64", expected.BASE64_RUN))
    found = " UNION ALL ".join(f"SELECT '{k}' AS kind, value FROM {every('docs', p)}" for k, p in kinds)
    return "WITH " + DOCS + f" SELECT kind, value, count(*) AS n FROM ({found}) GROUP BY ALL"


@query(_range_sql())
def s1_range_strings(spark, d):
    """Documents as large files, one a partition, read in ranges far smaller than the files: their strings, wherever a range ends."""
    path = new_path(spark, "range-files")
    docs(spark, d).select("t").write.option("lineSep", "\x01").text(path)
    found = range_source.carve_range_strings(range_source.scan_ranges(spark, path, 50_000), ("ascii", "printable", "base64"))
    return found.groupBy("kind", F.decode("value", "UTF-8").alias("value")).agg(F.count("*").alias("n"))


def _deflated_objects(spark, d) -> DataFrame:
    """Every document as a deflated stream of its whole text, by turns after an RTF head, after script, or bare."""

    @F.arrow_udf("binary")
    def deflated(texts: pa.Array) -> pa.Array:
        return pa.array([zlib.compress(t.encode()) for t in texts.to_pylist()], pa.binary())

    turn = F.col("artifact_id") % 3
    text = F.concat(F.when(turn == 0, F.lit("{\\rtf1 ")).when(turn == 1, F.lit("var x; ")).otherwise(F.lit("")), F.col("t"))
    data = docs(spark, d).select("artifact_id", lens(deflated(text)).alias("data"))
    # As embedded files have them: a type that ends in -stream, and by turns the length, none, and what only looks like one.
    length = F.when(turn == 0, F.concat(F.lit(" /Length "), F.length("data").cast("string"))).when(turn == 1, F.lit(" /Length 9 0 R")).otherwise(F.lit(""))
    head = F.concat(F.lit("4 0 obj <</Filter /FlateDecode /Subtype /application#2Foctet-stream"), length, F.lit(">>"))
    ends = F.when(turn == 0, F.lit("\r\n")).when(turn == 1, F.lit("\n")).otherwise(F.lit(" "))
    body = F.concat(head, F.lit(" stream"), ends, F.col("data"), F.lit("\nendstream endobj"))
    return data.select("artifact_id", F.lit(0).alias("ordinal"), body.alias("body"))


_STREAMS = "WITH " + DOCS + r""", streams AS (SELECT artifact_id, CASE artifact_id % 3 WHEN 0 THEN '{\rtf1 ' WHEN 1 THEN 'var x; ' ELSE '' END || t AS t FROM docs)"""


# An empty text without a head has no bytes to deflate, but its stream is whole all the same.
@query(_STREAMS + " SELECT artifact_id, sha256(t) AS sha256 FROM streams")
def s4_inflate_pdf_streams(spark, d):
    return pdf.expand_pdf_streams(_deflated_objects(spark, d)).select("artifact_id", F.sha2("content", 256).alias("sha256"))


@query(
    _STREAMS
    + " SELECT artifact_id, 'D15' AS rule_id, 'info' AS severity FROM streams WHERE contains(t, 'var ') OR contains(t, 'function') "
    + "UNION ALL SELECT artifact_id, 'E10', 'high' FROM streams WHERE starts_with(t, '{' || chr(92) || 'rt')"
)
def d15_e10_stream_findings(spark, d):
    found = pdf.stream_findings(pdf.expand_pdf_streams(_deflated_objects(spark, d)))
    return found.select("artifact_id", "rule_id", "severity")


@query(cte("mixed") + f"SELECT artifact_id, {MAGIC_SQL} AS kind FROM mixed")
def p2_classify_magic(spark, d):
    return columns.classify_magic(table(spark, d, "mixed").withColumn("content", unlens("t"))).select("artifact_id", "kind")


@query(cte("mixed") + f"SELECT artifact_id, CASE WHEN {MAGIC_SQL} = 'ole' THEN CASE WHEN contains(t, 'Microsoft Excel') THEN 'excel' WHEN contains(t, 'Microsoft Office Word') OR contains(t, 'Word.Document') THEN 'word' END END AS host_app FROM mixed")
def p3_classify_host_app(spark, d):
    return columns.classify_host_app(table(spark, d, "mixed").withColumn("content", unlens("t"))).select("artifact_id", "host_app")


@query(cte("parts") + "SELECT artifact_id, arg_max(kind, ordinal) AS doc_type FROM (SELECT *, CASE WHEN contains(part_path, 'xl/') THEN 'excel' WHEN contains(part_path, 'word/') THEN 'word' WHEN contains(part_path, 'ppt/') THEN 'ppt' END AS kind FROM parts) WHERE kind IS NOT NULL GROUP BY artifact_id")
def p4_ooxml_doc_type(spark, d):
    return columns.ooxml_doc_type(table(spark, d, "parts"))


@query(cte("xls") + "SELECT artifact_id, (ord(t[25]) + 256 * ord(t[26]))::BIGINT AS minor_version, (ord(t[27]) + 256 * ord(t[28]))::BIGINT AS major_version, (ord(t[29]) + 256 * ord(t[30]))::BIGINT AS byte_order, CASE ord(t[31]) WHEN 9 THEN 512::BIGINT WHEN 12 THEN 4096 END AS sector_size, CASE ord(t[31]) WHEN 9 THEN 480::BIGINT WHEN 12 THEN 4064 END AS payload_size, ord(t[27]) = 3 AS version_3 FROM xls")
def p5_cfb_header(spark, d):
    return columns.cfb_header(table(spark, d, "xls"))


PDF_OBJECTS = f"objects AS (SELECT artifact_id, pos AS ordinal, regexp_extract(value, '^([0-9]+) ', 1)::BIGINT AS obj_no, value AS body FROM {every('pdf', expected.PDF_OBJECT)})"


@query(cte("pdf") + f", {PDF_OBJECTS} SELECT artifact_id, ordinal, obj_no, regexp_extract(body, '^([0-9]+ [0-9]+ obj ?<<[\\x00-\\xff]*?>>)', 1) AS header, body FROM objects")
def g11_p6_pdf_objects(spark, d):
    return longs(carve.carve_pdf_objects(table(spark, d, "pdf")))


@query("SELECT page_id, array_to_string(list_transform(string_split(chr(1) || url || chr(1), '/'), lambda x: regexp_replace(x, '^\\x01+|\\x01+$', '', 'g')), chr(92)) AS part_name FROM pages")
def p7_clean_part_name(spark, d):
    url = F.concat(F.lit("\x01"), F.col("url"), F.lit("\x01"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", columns.clean_part_name(url).alias("part_name"))


@query("WITH " + DOCS + " SELECT artifact_id, left(t, 100) AS vba, left(t, 150) AS xlm, list_slice(string_split(t, ' '), 1, 20)::VARCHAR[] AS items FROM docs")
def p8_l2_clip_description(spark, d):
    items = columns.clip_description(F.split("t", " "), "base64")
    t = F.col("t")
    return docs(spark, d).select("artifact_id", columns.clip_description(t, "vba").alias("vba"), columns.clip_description(t, "xlm").alias("xlm"), items.alias("items"))


@query(cte("mixed") + "SELECT artifact_id, regexp_replace(left(t, 1000), '[^\\x20-\\x7e\\n]', '.', 'g') AS preview FROM mixed")
def p9_printable_preview(spark, d):
    return table(spark, d, "mixed").select("artifact_id", columns.printable_preview(F.col("t")).alias("preview"))


# --- carving ---


def _positions(df: DataFrame) -> DataFrame:
    return longs(df.select("artifact_id", "kind", "pos", "value"))


@query("WITH " + DOCS + f" SELECT artifact_id, 'ascii' AS kind, pos, value FROM {every('docs', expected.ASCII_RUN)}")
def g1_carve_ascii(spark, d):
    return _positions(carve.carve_ascii(docs(spark, d)))


@query(cte("wide_probe") + f"SELECT artifact_id, 'wide' AS kind, pos, replace(value, chr(0), '') AS value FROM {every('wide_probe', expected.WIDE_RUN)}")
def g2_carve_wide(spark, d):
    return _positions(carve.carve_wide(table(spark, d, "wide_probe")))


@query("WITH " + DOCS + f" SELECT artifact_id, 'printable' AS kind, pos, value FROM {every('docs', expected.PRINTABLE_RUN)}")
def g3_carve_printable(spark, d):
    return _positions(carve.carve_printable(docs(spark, d)))


@query(cte("wide_probe") + f"SELECT artifact_id, 'base64' AS kind, pos, value FROM {every('wide_probe', expected.BASE64_RUN)} WHERE length(value) > 50 AND length(value) % 4 = 0")
def g4_f6_e12_carve_base64(spark, d):
    return _positions(carve.carve_base64(table(spark, d, "wide_probe")))


@query(
    cte("wide_probe")
    + "SELECT artifact_id, kind, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT artifact_id, '{k}' AS kind FROM {every('wide_probe', p)}" for k, p in (("ascii", expected.ASCII_RUN), ("wide", expected.WIDE_RUN), ("printable", expected.PRINTABLE_RUN)))
    + ") GROUP BY ALL"
)
def u3_union_of_strings(spark, d):
    return carve.carve_strings(table(spark, d, "wide_probe")).groupBy("artifact_id", "kind").agg(F.count("*").alias("n"))


_PART_NAMES = "SELECT doc_id AS artifact_id, CASE doc_id % 4 WHEN 0 THEN 'CompObj' WHEN 1 THEN 'x/SummaryInformation' ELSE 'WordDocument' END AS part_path, coalesce(text, '') AS t FROM documents"


@query(
    f"WITH p AS (SELECT * FROM ({_PART_NAMES}) WHERE artifact_id % 4 > 1), s AS (SELECT artifact_id, 'ascii' AS kind, value FROM {every('p', expected.ASCII_RUN)} "
    f"UNION ALL SELECT artifact_id, 'printable', value FROM {every('p', expected.PRINTABLE_RUN)}) "
    "SELECT artifact_id, kind, count(*) AS n, sum(length(value))::BIGINT AS chars FROM s WHERE length(value) > CASE kind WHEN 'printable' THEN 15 ELSE 8 END GROUP BY artifact_id, kind"
)
def f3_f5_scanned_strings(spark, d):
    spark.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("documents")
    parts = carve.carved_parts(spark.sql(_PART_NAMES))
    strings = carve.scannable(carve.carve_ascii(parts).unionByName(carve.carve_printable(parts)))
    return strings.groupBy("artifact_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


def _clean(name: str) -> str:
    return f"cleaned AS (SELECT artifact_id, translate(t, chr(13)||chr(10)||chr(9)||' ', '') AS t FROM {name})"


def _hex(df: DataFrame) -> DataFrame:
    return longs(df.select("artifact_id", "pos", "hex", F.lower(F.hex("content")).alias("content_hex")))


VALID_HEX = "CASE WHEN regexp_matches(value, '^(?:[0-9a-fA-F]{2})+$') THEN lower(value) END"


@query(cte("rtf_probe") + f", {_clean('rtf_probe')} SELECT artifact_id, pos, value AS hex, {VALID_HEX} AS content_hex FROM {every('cleaned', expected.RTF_OLE, 1)} WHERE length(value) > 200")
def g5_g6_f1_carve_rtf_ole(spark, d):
    return _hex(carve.carve_rtf_ole(table(spark, d, "rtf_probe")))


# The digits as they were put in, whole bytes of them: no pattern finds them here.
BLOBS = "blobs AS (SELECT artifact_id, k, body, left(h, length(h) - length(h) % 2) AS hex FROM rtf_hex WHERE length(h) - length(h) % 2 > 200)"


@query(cte("rtf_hex") + f", {BLOBS} SELECT artifact_id, 0::BIGINT AS pos, hex, hex AS content_hex FROM blobs")
def g7_carve_rtf_blobs(spark, d):
    return _hex(carve.carve_rtf_blobs(table(spark, d, "rtf_probe")))


@query(cte("aux_probe") + f", {_clean('aux_probe')} SELECT artifact_id, pos, value AS hex, {VALID_HEX} AS content_hex FROM {every('cleaned', expected.RTF_AUX, 1)} WHERE length(value) > 200")
def g8_carve_rtf_aux(spark, d):
    return _hex(carve.carve_rtf_aux(table(spark, d, "aux_probe")))


@query(cte("rtf_probe") + f", {_clean('rtf_probe')} SELECT artifact_id, hex FROM (SELECT artifact_id, regexp_extract(t, '(d0cf11e0a1b11ae1(?:[0-9a-f]{{2}})*)', 1) AS hex FROM cleaned) WHERE hex <> ''")
def g9_carve_hex_ole(spark, d):
    return carve.carve_hex_ole(table(spark, d, "rtf_probe")).select("artifact_id", "hex")


@query(cte("part_probe") + f"SELECT artifact_id, (place - 1)::BIGINT AS \"offset\", substr(t, place) AS t FROM (SELECT *, instr(t, {OLE}) AS place FROM part_probe) WHERE place > 1")
def g10_e5_carve_embedded_ole(spark, d):
    return carve.carve_embedded_ole(table(spark, d, "part_probe"))


@query(cte("pdf") + f", {PDF_OBJECTS}, h AS (SELECT artifact_id, ordinal, obj_no, lower(regexp_extract(replace(body, ' ', ''), 'stream((?:[0-9a-fA-F]{{2}})+)', 1)) AS hex FROM objects WHERE contains(body, 'ASCIIHexDecode')) SELECT artifact_id, ordinal, obj_no, hex, contains(hex, '5c7274') AS has_rtf FROM h WHERE hex <> ''")
def g12_decode_pdf_ascii_hex(spark, d):
    objects = carve.carve_pdf_objects(table(spark, d, "pdf"))
    return longs(carve.decode_pdf_ascii_hex(objects).drop("content"))


BOFS = "bofs AS (SELECT artifact_id, unnest([527, 603, 619, 635])::BIGINT AS \"offset\", unnest(['globals', 'worksheet', CASE WHEN artifact_id % 5 = 0 THEN 'worksheet' ELSE 'xlm' END, 'worksheet']) AS substream FROM xls)"
SHEETS = "sheets AS (SELECT artifact_id, unnest([1, 2, 3])::BIGINT AS sheet_no, unnest([76, 92, 108])::BIGINT AS bof_offset, unnest(CASE WHEN artifact_id % 5 = 0 THEN ['visible', 'visible', 'visible'] ELSE ['visible', 'very hidden', 'hidden'] END) AS visibility, unnest([false, artifact_id % 5 <> 0, false]) AS xlm, t FROM xls)"
# Read from the bytes, not from the layout: places of the marks, one after the other.
MARKS = "SELECT artifact_id, i::BIGINT AS \"offset\" FROM (SELECT artifact_id, t, unnest(range(length(t))) AS i FROM xls) WHERE substr(t, i + 1, {n}) = {mark}"


@query(cte("xls") + "SELECT artifact_id, i::BIGINT AS \"offset\", (ord(t[i + 3]) + 256 * ord(t[i + 4]))::BIGINT AS rec_len, CASE ord(t[i + 6]) WHEN 5 THEN '5/7' WHEN 6 THEN '8' END AS biff, CASE ord(t[i + 7]) WHEN 5 THEN 'globals' WHEN 16 THEN 'worksheet' WHEN 64 THEN 'xlm' END AS substream FROM (SELECT artifact_id, t, unnest(range(length(t) - 11)) AS i FROM xls) WHERE substr(t, i + 1, 2) = chr(9)||chr(8)")
def g13_x2_carve_bof(spark, d):
    return longs(carve.carve_bof(table(spark, d, "xls")))


@query(cte("xls") + "SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY i) AS sheet_no, i::BIGINT AS record_offset, ord(t[i + 5])::BIGINT AS bof_offset, CASE ord(t[i + 9]) WHEN 0 THEN 'visible' WHEN 1 THEN 'hidden' ELSE 'very hidden' END AS visibility, ord(t[i + 10]) = 1 AS xlm, regexp_extract(substr(t, i + 13, 10), '^([ST][0-9?]+)', 1) AS sheet_name FROM (SELECT artifact_id, t, unnest(range(length(t) - 9)) AS i FROM xls) WHERE substr(t, i + 1, 4) = chr(133)||chr(0)||chr(14)||chr(0)")
def g14_g15_carve_boundsheets(spark, d):
    return longs(carve.carve_boundsheets(table(spark, d, "xls")))


@query(cte("macro_probe") + ", m AS (SELECT artifact_id, value AS t FROM macro_probe WHERE contains(value, 'Function') OR contains(value, 'Sub ')) SELECT artifact_id, pos, value FROM " + every("m", expected.FUNCTION_NAME))
def g17_carve_functions(spark, d):
    return longs(carve.carve_functions(table(spark, d, "macro_probe").withColumnRenamed("value", "t")))


# --- rules ---


@query(cte("string_probe") + rules_sql("string_probe", "artifact_id, part_path, k", expected.STRING_RULES))
def i_string_rules(spark, d):
    return longs(rules.apply_rules(table(spark, d, "string_probe")))


@query("WITH s AS (SELECT page_id AS artifact_id, url AS value FROM pages) " + rules_sql("s", "artifact_id", expected.STRING_RULES))
def i2_page_urls(spark, d):
    urls = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("artifact_id"), F.col("url").alias("value"))
    return rules.apply_rules(urls)


@query(cte("string_probe") + " UNION ALL ".join(f"SELECT artifact_id, '{r.rule_id}' AS rule_id, value AS description FROM string_probe WHERE {rule_sql(r, 'value')}" for r in expected.STRING_RULES[:4]))
def j2_rule_table_join(spark, d):
    rows = [(r.rule_id, r.includes, r.excludes) for r in rules.STRING_RULES[:4]]
    rule_rows = spark.createDataFrame(rows, "rule_id string, includes array<string>, excludes array<string>")
    return rules.match_rule_table(table(spark, d, "string_probe"), rule_rows)


URL_SQL = """CASE WHEN regexp_extract(value, '(https?://[^\\n\\r]*\\.[^\\n\\r]*/[^\\n\\r]*")', 1) <> '' THEN regexp_extract(value, '(https?://[^\\n\\r]*\\.[^\\n\\r]*/[^\\n\\r]*")', 1) ELSE regexp_extract(value, '(http[^\\s"]*)', 1) END"""


@query(cte("macro_probe") + rules_sql("macro_probe", "artifact_id, part_path, k", expected.MACRO_RULES, described={r.rule_id: URL_SQL if r.rule_id == "V4" else "left(value, 100)" for r in expected.MACRO_RULES}))
def v_x1_macro_rules(spark, d):
    return longs(rules.macro_findings(table(spark, d, "macro_probe")))


@query(cte("mixed") + r"""SELECT artifact_id, len(list_filter(string_split(m, chr(10)), lambda s: NOT (trim(s) = '' OR starts_with(s, 'Attribute ') OR s = 'Option Explicit'))) = 0 AS only_attributes, regexp_replace(m, '^(?:Attribute VB_[^\n]+? = [^\n]+\n)+', '') AS code FROM (SELECT artifact_id, CASE WHEN artifact_id % 3 = 0 THEN 'Attribute VB_Name = "M"' || chr(10) || 'Option Explicit' ELSE t END AS m FROM mixed WHERE kind_no = 6)""")
def v6_v7_attributes(spark, d):
    rows = table(spark, d, "mixed").where("kind_no = 6")
    m = F.when(F.col("artifact_id") % 3 == 0, F.lit('Attribute VB_Name = "M"\nOption Explicit')).otherwise(F.col("t"))
    return rows.select("artifact_id", rules.only_attributes(m).alias("only_attributes"), rules.strip_attributes(m).alias("code"))


@query(cte("xls") + "SELECT artifact_id, bool_or(contains(t, r3)) AS x3_hidden_sheet, bool_or(contains(t, r4)) AS x4_xlm_sheet, bool_or(contains(t, r2)) AS x2_xlm_substream FROM "
    + "(SELECT *, chr(133)||chr(0)||chr(14)||chr(0)||chr(92)||chr(0)||chr(0)||chr(0) AS r, r||chr(2) AS r3, r||chr(2)||chr(1) AS r4, chr(9)||chr(8)||chr(16)||chr(0)||chr(0)||chr(6)||chr(64) AS r2 FROM xls) GROUP BY artifact_id")
def a2_x2_x3_x4_sheet_flags(spark, d):
    xls = table(spark, d, "xls")
    return biff.sheet_flags(carve.carve_boundsheets(xls), carve.carve_bof(xls))


@query(cte("part_probe") + f""", f AS (SELECT artifact_id, contains(t, {fixtures._CLSID}) AS c, contains(t, 'Microsoft Equation 3.0') AS p FROM part_probe WHERE length(t) > 50)
SELECT artifact_id, CASE WHEN c AND p THEN 'E1' WHEN c THEN 'E2' ELSE 'E3' END AS rule_id, CASE WHEN c THEN 'high' ELSE 'info' END AS severity, CASE WHEN p THEN 'Microsoft Equation 3.0' ELSE 'class id' END AS description FROM f WHERE c OR p""")
def e1_e2_e3_f2_equation(spark, d):
    return rules.equation_findings(table(spark, d, "part_probe")).select("artifact_id", "rule_id", "severity", "description")


@query(cte("part_probe") + "SELECT artifact_id, 'E11' AS rule_id, 'info' AS severity, part_path AS description FROM part_probe WHERE artifact_id % 3 < 2")
def e11_f8_encrypted(spark, d):
    return rules.encrypted_containers(table(spark, d, "part_probe"))


def _blob_rules_sql(columns: str = "artifact_id, ") -> str:
    """E4, E7, E8 and E9 by what the blobs say in clear."""
    return (
        f"SELECT {columns}'E4' AS rule_id FROM blobs WHERE k = 0 OR k < 3 AND regexp_matches(body, '(?i)equation') UNION ALL SELECT {columns}'E7' FROM blobs "
        f"UNION ALL SELECT {columns}'E8' FROM blobs WHERE k = 1 OR k < 3 AND (contains(body, 'Function') OR contains(body, 'Sub ')) UNION ALL SELECT {columns}'E9' FROM blobs WHERE k = 3"
    )


@query(cte("rtf_hex") + f", {BLOBS}, found AS ({_blob_rules_sql()}) SELECT artifact_id, rule_id FROM found WHERE artifact_id % 4 <> 2")
def e4_e7_e8_e9_blob_findings(spark, d):
    blobs = carve.carve_rtf_blobs(table(spark, d, "rtf_probe")).where("content is null or not contains(lower(hex), 'd0cf11')")
    return rules.blob_findings(blobs.withColumn("t", lens("content"))).select("artifact_id", "rule_id")


@query(cte("part_probe") + "SELECT artifact_id, pos, value AS description, 'D16' AS rule_id, 'high' AS severity FROM " + every("part_probe", r"\x13\s*DDEAUTO[^\x14]+"))
def d16_dde_fields(spark, d):
    return longs(rules.dde_fields(table(spark, d, "part_probe")))


# --- containers ---


@query(cte("parts") + "SELECT artifact_id, part_path, min(ordinal) AS ordinal, arg_min(t, ordinal) AS t FROM parts GROUP BY artifact_id, part_path")
def u1_distinct_parts(spark, d):
    return ooxml.distinct_parts(table(spark, d, "parts"))


@query(cte("parts") + "SELECT artifact_id, part_path, array_to_string(regexp_extract_all(t, '<t>([^<]*)</t>', 1), ', ') AS value FROM parts WHERE contains(part_path, 'sharedStrings')")
def s5_o9_a1_shared_strings(spark, d):
    return ooxml.xml_shared_strings(table(spark, d, "parts"))


@query(cte("parts") + "SELECT artifact_id, part_path, 'A1' AS cell_ref, regexp_extract(t, '<v>([^<]*)</v>', 1) AS value FROM parts WHERE contains(part_path, 'xl/worksheets/') "
    + "UNION ALL SELECT artifact_id, part_path, 'C1', regexp_extract(t, '<is><t>([^<]*)</t></is>', 1) FROM parts WHERE contains(part_path, 'xl/worksheets/')")
def s6_f7_cells(spark, d):
    return ooxml.xml_cells(table(spark, d, "parts"))


def _said(places: dict[str, str], part: str) -> str:
    """What the fixture says at each place of a part, as text."""
    return " UNION ALL ".join(f"SELECT artifact_id, '{part}' AS part_path, '{place}' AS place, {value} AS value FROM said" for place, value in places.items())


_STRING_VALUES = {"0": "' a & powershell ' || body", "2": "body || '-rich'", "3": "'<' || body || '&amp;>z'"}
_CELL_VALUES = {"A1": _STRING_VALUES["0"], "B1": _STRING_VALUES["2"], "C1": _STRING_VALUES["3"], "G2": "'inlineA'", "H2": "'x<' || body"}


@query(
    "WITH said AS (" + fixtures.sql_of("bodies", "duckdb") + ") "
    + _said(_STRING_VALUES | {"1": "''"}, "xl/sharedStrings.xml") + " UNION ALL " + _said(_CELL_VALUES, "xl/worksheets/sheet1.xml")
    + " UNION ALL " + _said({"A1": """'=EXEC("cmd ' || body || '")'"""}, "xl/macrosheets/sheet1.xml")
)
def s5_s6_xml_structure(spark, d):
    """Shared strings by number and cells with their strings, of workbooks with prefixes, references, CDATA, runs and cut parts."""
    parts = table(spark, d, "xml_parts")
    named = written(ooxml.shared_strings(parts), "shared-strings", "zstd")
    strings = named.withColumn("place", F.col("idx").cast("string"))
    cells = ooxml.xml_cells(parts, named).withColumn("place", F.col("cell_ref"))
    return strings.select("artifact_id", "part_path", "place", "value").unionByName(cells.select("artifact_id", "part_path", "place", "value"))


@query(
    "SELECT doc_id AS artifact_id, 'xl/sharedStrings.xml' AS part_path FROM documents WHERE doc_id % 5 = 0 "
    "UNION ALL SELECT doc_id, 'xl/worksheets/sheet1.xml' FROM documents WHERE doc_id % 7 = 0"
)
def s5_s6_damaged_parts(spark, d):
    """The parts that are no well-formed XML."""
    return ooxml.damaged_parts(table(spark, d, "xml_parts")).select("artifact_id", "part_path")


@query(cte("parts") + "SELECT artifact_id, part_path, CASE WHEN part_path LIKE '%.bin' THEN 'binary' WHEN part_path LIKE '%.rels' THEN 'relationships' WHEN part_path LIKE '%sharedStrings.xml%' THEN 'shared strings' WHEN part_path LIKE '%webSettings.xml%' THEN 'web settings' WHEN part_path LIKE '%document.xml%' OR part_path LIKE '%workbook.xml%' THEN 'main' WHEN part_path LIKE '%xl/worksheets/%' THEN 'sheet' END AS part_role FROM parts")
def f11_part_role(spark, d):
    return ooxml.with_role(table(spark, d, "parts")).select("artifact_id", "part_path", "part_role")


def _rels_sql(p: str) -> str:
    return quoted(f"({p})")


@query(cte("parts") + " UNION ALL ".join(f"SELECT artifact_id, part_path, '{r}' AS rule_id, unnest(regexp_extract_all(t, {quoted(p)}, 0)) AS description FROM parts WHERE part_path LIKE '%.rels'" for r, p in expected.RELS))
def g16_carve_rels(spark, d):
    return ooxml.carve_rels(table(spark, d, "parts"))


@query(
    cte("parts")
    + "SELECT * FROM (SELECT artifact_id, part_path, CASE "
    + " ".join(f"WHEN regexp_matches(t, {quoted(p)}) THEN '{r}' " for r, p in expected.RELS)
    + "END AS rule_id, CASE "
    + " ".join(f"WHEN regexp_matches(t, {quoted(p)}) THEN regexp_extract(t, {_rels_sql(p)}, 1) " for r, p in expected.RELS)
    + "END AS description FROM parts WHERE part_path LIKE '%.rels') WHERE rule_id IS NOT NULL"
)
def o1_o4_rels_findings(spark, d):
    return ooxml.rels_findings(table(spark, d, "parts")).select("artifact_id", "part_path", "rule_id", "description")


@query(
    cte("parts")
    + f"SELECT artifact_id, part_path, 'O5' AS rule_id, regexp_extract(t, {_rels_sql(expected.FRAME)}, 1) AS description FROM parts WHERE part_path LIKE '%webSettings%' "
    + "UNION ALL SELECT artifact_id, part_path, 'O6', regexp_extract(t, '<instrText>([^<]*)<', 1) FROM parts WHERE part_path LIKE '%document.xml' "
    + "UNION ALL SELECT artifact_id, part_path, 'O7', left(regexp_extract(t, '>&lt([^\\n\\r]*)', 1), 100) FROM parts WHERE part_path LIKE '%workbook.xml' "
    + "UNION ALL SELECT artifact_id, part_path, 'O8', '<oleObjects>a</oleObjects>' FROM parts WHERE part_path LIKE '%worksheets%'"
)
def o5_o8_part_findings(spark, d):
    return ooxml.part_findings(table(spark, d, "parts")).select("artifact_id", "part_path", "rule_id", "description")


@query(cte("parts") + "SELECT artifact_id, string_agg(DISTINCT part_path, ', ') AS description, 'O10' AS rule_id, 'low' AS severity FROM parts WHERE part_path LIKE '%xl/activeX%.bin%' GROUP BY artifact_id")
def o10_activex(spark, d):
    return ooxml.activex_findings(table(spark, d, "parts"))


# --- PDF ---

_FLAGS = [
    ("D2", "/Type ?/EmbeddedFile"), ("D3", "/Type ?/ObjStm"), ("D8", r"/AA\b"), ("D9", "/OpenAction"), ("D12", "/Launch"), ("D14", "/SubmitForm"),
]
_FIRSTS = [("D4", expected.EXPORT), ("D6", expected.UNC), ("D7", r"JS \d+ 0 R"), ("D10", r"/O \d+ 0 R"), ("D11", r"/OpenAction \d+ 0 R"), ("D13", "/GoTo[RE]?")]


@query(
    cte("pdf")
    + f", {PDF_OBJECTS} SELECT artifact_id, ordinal, 'D1' AS rule_id, unnest(regexp_extract_all(body, '{expected.URI}', 0)) AS description FROM objects "
    + "".join(f"UNION ALL SELECT artifact_id, ordinal, '{r}', '' FROM objects WHERE regexp_matches(body, '{p}') " for r, p in _FLAGS)
    + "".join(f"UNION ALL SELECT artifact_id, ordinal, '{r}', regexp_extract(body, '({p})', 1) FROM objects WHERE regexp_matches(body, '{p}') " for r, p in _FIRSTS)
    + f"UNION ALL SELECT artifact_id, ordinal, 'D5', regexp_extract(body, '({expected.FILE_REF})', 1) FROM objects WHERE regexp_matches(body, '/Type ?/Filespec') AND regexp_matches(body, '{expected.FILE_REF}')"
)
def d1_d14_object_findings(spark, d):
    found = pdf.object_findings(carve.carve_pdf_objects(table(spark, d, "pdf")))
    return longs(found.select("artifact_id", "ordinal", "rule_id", "description"))


@query(cte("pdf") + f", {PDF_OBJECTS} SELECT artifact_id, bool_or(regexp_matches(body, 'JS [0-9]+ 0 R')) AS has_js, bool_or(regexp_matches(body, '/AA\\b')) AS has_aa, bool_or(contains(body, '/OpenAction')) AS has_open_action, bool_or(contains(body, '/Launch')) AS has_launch FROM objects GROUP BY artifact_id")
def a2_pdf_flags(spark, d):
    return pdf.object_flags(carve.carve_pdf_objects(table(spark, d, "pdf")))


@query(
    cte("pdf")
    + f", {PDF_OBJECTS}, refs AS ("
    + " UNION ALL ".join(f"SELECT artifact_id, obj_no AS src_obj, '{k}' AS kind, unnest(regexp_extract_all(body, '{p}', 1))::BIGINT AS dst_obj FROM objects" for k, p in expected.REFS)
    + ") SELECT r.artifact_id, r.dst_obj, r.src_obj, r.kind, o.ordinal AS dst_ordinal FROM refs r LEFT JOIN objects o ON o.artifact_id = r.artifact_id AND o.obj_no = r.dst_obj"
)
def j3_resolve_pdf_refs(spark, d):
    objects = carve.carve_pdf_objects(table(spark, d, "pdf"))
    return pdf.resolve_pdf_refs(pdf.pdf_refs(objects), objects)


# --- workbook records ---


def _placed(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    xls = table(spark, d, "xls")
    bofs = carve.carve_bof(xls)
    placed = biff.sheet_to_bof(carve.carve_boundsheets(xls), bofs)
    return placed, bofs, xls.select("artifact_id", F.length("t").cast("bigint").alias("length"))


@query(cte("xls") + f", {BOFS}, {SHEETS} SELECT s.artifact_id, s.sheet_no, s.visibility, 527 + s.bof_offset AS bof_at, b.substream FROM sheets s LEFT JOIN bofs b ON b.artifact_id = s.artifact_id AND b.\"offset\" = 527 + s.bof_offset WHERE NOT (s.artifact_id % 7 = 3 AND s.sheet_no = 2)")
def j4_w2_f9_f10_sheet_to_bof(spark, d):
    placed, _, lengths = _placed(spark, d)
    return carve.valid_sheets(placed, lengths).select("artifact_id", "sheet_no", "visibility", "bof_at", "substream")


@query(cte("xls") + f", {BOFS}, eofs AS ({MARKS.format(n=4, mark='chr(10)||chr(0)||chr(0)||chr(0)')}) SELECT b.artifact_id, b.\"offset\", coalesce(min(e.\"offset\"), max(length(t)))::BIGINT AS end_at, (coalesce(min(e.\"offset\"), max(length(t))) - b.\"offset\")::BIGINT AS size FROM bofs b JOIN xls USING (artifact_id) LEFT JOIN eofs e ON e.artifact_id = b.artifact_id AND e.\"offset\" > b.\"offset\" GROUP BY b.artifact_id, b.\"offset\"")
def j5_w4_a3_bof_extent(spark, d):
    _, bofs, lengths = _placed(spark, d)
    return biff.bof_extent(bofs, carve.carve_eof(table(spark, d, "xls")), lengths)


@query(cte("xls") + f", {SHEETS} SELECT artifact_id, sheet_no, 527 + bof_offset AS bof_at, coalesce(lead(527 + bof_offset) OVER w, length(t))::BIGINT AS end_at, (coalesce(lead(527 + bof_offset) OVER w, length(t)) - 527 - bof_offset)::BIGINT AS size FROM sheets WINDOW w AS (PARTITION BY artifact_id ORDER BY bof_offset)")
def w1_next_sheet(spark, d):
    placed, _, lengths = _placed(spark, d)
    return biff.next_sheet(placed, lengths)


# --- findings ---


@query(cte("findings") + "SELECT artifact_id, description, seq, rule_id, indication, severity FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, description ORDER BY seq) AS rn FROM findings) WHERE rn = 1")
def k1_w3_dedup_exact(spark, d):
    return findings.dedup_findings(table(spark, d, "findings"))


@query(cte("findings") + "SELECT * FROM findings d WHERE NOT EXISTS (SELECT 1 FROM findings e WHERE e.artifact_id = d.artifact_id AND e.seq < d.seq AND (contains(e.description, d.description) OR contains(e.indication, d.description)))")
def k1_j6_dedup_contains(spark, d):
    return findings.dedup_findings(table(spark, d, "findings"), "contains")


@query(cte("findings") + "SELECT artifact_id, string_agg(description, ', ' ORDER BY seq) AS joined FROM findings GROUP BY artifact_id")
def a1_join_strings(spark, d):
    return findings.join_strings(table(spark, d, "findings").select("artifact_id", F.col("seq").alias("pos"), F.col("description").alias("value")))


@query(cte("findings") + "SELECT artifact_id, arg_min(description, seq) AS first_value, arg_max(description, seq) AS last_value FROM findings GROUP BY artifact_id")
def a4_first_last(spark, d):
    return findings.first_last(table(spark, d, "findings").select("artifact_id", F.col("seq").alias("pos"), F.col("description").alias("value")))


_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in expected.SEVERITIES)


@query(cte("findings") + f"SELECT artifact_id, {_COUNTS} FROM findings GROUP BY artifact_id")
def a5_severity_rollup(spark, d):
    return findings.severity_rollup(table(spark, d, "findings"))


@query(cte("findings") + "SELECT regexp_extract(rule_id, '^([A-Z]+)', 1) AS family, rule_id, count(DISTINCT artifact_id) AS n_artifacts, count(*) AS n_findings FROM findings GROUP BY ROLLUP (regexp_extract(rule_id, '^([A-Z]+)', 1), rule_id)")
def a6_rule_prevalence(spark, d):
    return findings.rule_prevalence(table(spark, d, "findings"))


@query(cte("findings") + "SELECT artifact_id, ['info', 'low', 'medium', 'high'][max(list_position(['info', 'low', 'medium', 'high'], severity))] AS verdict FROM findings WHERE seq >= artifact_id % 4 GROUP BY artifact_id")
def a7_verdict(spark, d):
    return findings.verdict(table(spark, d, "findings").where("seq >= artifact_id % 4"))


@query(
    cte("findings") + ", f AS (SELECT artifact_id, rule_id, CASE rule_id WHEN 'R1' THEN 'high' ELSE severity END AS severity FROM findings "
    "WHERE rule_id IN ('R0', 'R1') OR rule_id = 'R2' AND artifact_id % 3 <> 0 UNION ALL SELECT artifact_id, 'R3', 'info' FROM findings WHERE seq = 3), "
    f"c AS (SELECT artifact_id, {_COUNTS} FROM f GROUP BY artifact_id) "
    "SELECT *, CASE WHEN n_high > 0 THEN 'high' WHEN n_medium > 0 THEN 'medium' WHEN n_low > 0 THEN 'low' ELSE 'info' END AS verdict FROM c"
)
def a5_a7_rollup_ledger(spark, d):
    """Two batches, one of them twice, then new versions of three rules (other severity, fewer findings, other findings): rollups of the sum."""
    found = table(spark, d, "findings")
    ledger = rollups.Ledger(spark, new_path(spark, "ledger"))
    odd = F.col("artifact_id") % 2 == 1
    for change, rows in (("batch-1", found.where(~odd)), ("batch-2", found.where(odd)), ("batch-2", found.where(odd))):
        ledger.add(rows, change)
    ledger.change_rule("R1", found.where("rule_id = 'R1'").withColumn("severity", F.lit("high")), "R1-v2")
    ledger.change_rule("R2", found.where("rule_id = 'R2' and artifact_id % 3 <> 0"), "R2-v2")
    ledger.change_rule("R3", found.where("seq = 3").withColumn("rule_id", F.lit("R3")).withColumn("severity", F.lit("info")), "R3-v2")
    return ledger.rollup()


@query(cte("findings") + "SELECT rule_id, count(DISTINCT artifact_id) AS n_artifacts, count(*) AS n_findings, true AS within FROM findings GROUP BY rule_id")
def a6_prevalence_sketches(spark, d):
    """Prevalence from merged sketches of days: the exact numbers, and whether the estimate is within three standard errors."""
    found = table(spark, d, "findings").withColumn("day", F.col("artifact_id") % 30)
    estimated = sketches.prevalence(sketches.prevalence_sketches(found, "day")).withColumnRenamed("n_artifacts", "estimate")
    exact = found.groupBy("rule_id").agg(F.countDistinct("artifact_id").alias("n_artifacts"))
    off = F.abs(F.col("estimate") - F.col("n_artifacts"))
    within = off <= F.col("n_artifacts") * (3 * sketches.relative_error()) + 1
    return exact.join(estimated, "rule_id").select("rule_id", "n_artifacts", "n_findings", within.alias("within"))


@query(cte("findings") + "SELECT description, count(*) AS n_findings, count(DISTINCT artifact_id) AS n_artifacts FROM findings GROUP BY description HAVING count(*) > (SELECT count(*) FROM findings) * 0.01")
def j8_frequent_indicators(spark, d):
    """Descriptions of more than a hundredth of all findings, by sketches of days and one count of the candidates."""
    found = table(spark, d, "findings").withColumn("day", F.col("artifact_id") % 30)
    return sketches.frequent_indicators(found, sketches.indicator_sketches(found, "day"), 0.01)


@query(cte("findings") + "SELECT * FROM findings ORDER BY artifact_id, seq")
def l1_document_order(spark, d):
    return findings.document_order(table(spark, d, "findings"))


@query(cte("findings") + "SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY seq) <= 2")
def l2_first_findings(spark, d):
    return findings.first_findings(table(spark, d, "findings"), 2)


@query("WITH a AS (SELECT doc_id AS artifact_id, sha256(text) AS sha256 FROM documents) SELECT artifact_id, sha256, n_copies FROM a JOIN (SELECT sha256, count(*) AS n_copies FROM a GROUP BY sha256 HAVING count(*) > 1) USING (sha256)")
def j7_duplicate_artifacts(spark, d):
    found = sources.artifacts_from_table(spark.read.parquet(f"{d}/documents.parquet").where("text is not null"), "doc_id", "text")
    return findings.duplicate_artifacts(columns.with_sha256(found))


@query(cte("findings") + "SELECT description, count(DISTINCT artifact_id) AS n_artifacts, min(artifact_id) AS first_artifact FROM findings GROUP BY description HAVING count(DISTINCT artifact_id) > 1")
def j8_shared_indicators(spark, d):
    return findings.shared_indicators(table(spark, d, "findings"))


_CLASS_IDS = (
    f"(VALUES ({fixtures._CLSID}, 'equation: editor of version 3'), ({fixtures._SHORTCUT}, 'shell: shortcut file'), "
    f"({fixtures._MONIKER}, 'script: moniker of a component')) AS ids(sig, label)"
)


@query(cte("part_probe") + f"SELECT artifact_id, label FROM part_probe, {_CLASS_IDS} WHERE contains(t, sig)")
def j1_match_signatures(spark, d):
    return findings.match_signatures(table(spark, d, "part_probe"), signatures.table(spark))


# Pieces of every text by its number, long and short, as signatures; and as rules of an include word or two and an exclude word.
_MANY = (
    "many AS (SELECT doc_id, substr(coalesce(text, ''), cast(1 + doc_id % 50 AS INT), cast(3 + doc_id % 14 AS INT)) AS sig, "
    "substr(coalesce(text, ''), 30, 8) AS word, substr(coalesce(text, ''), 3, 9) AS other FROM documents)"
)


@query(f"WITH {DOCS}, {_MANY}, s AS (SELECT DISTINCT sig FROM many WHERE sig <> '') SELECT artifact_id, sig AS label FROM docs JOIN s ON contains(t, sig)")
def j1_many_signatures(spark, d):
    """As many signatures as there are documents, looked for in all of them."""
    spark.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("documents")
    many = spark.sql(f"WITH {_MANY} SELECT DISTINCT sig, sig AS label FROM many WHERE sig <> ''")
    return findings.match_signatures(docs(spark, d), many)


@query(
    f"WITH {DOCS}, {_MANY}, r AS (SELECT * FROM many WHERE sig <> '' OR word <> '') "
    "SELECT artifact_id, 'M' || doc_id AS rule_id, t AS description FROM docs JOIN r ON (sig <> '' AND contains(t, sig) OR word <> '' AND contains(t, word)) AND NOT (other <> '' AND contains(t, other))"
)
def j2_many_rules(spark, d):
    """A rule for every document (words of its text, and one that must not occur), over all documents."""
    spark.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("documents")
    many = spark.sql(f"WITH {_MANY} SELECT 'M' || doc_id AS rule_id, array(sig, word) AS includes, array(other) AS excludes FROM many")
    filled = [F.filter(c, lambda x: x != "").alias(c) for c in ("includes", "excludes")]
    return rules.match_rule_table(docs(spark, d).withColumnRenamed("t", "value"), many.select("rule_id", *filled))


@query(
    cte("string_probe", "macro_probe", "part_probe", "parts")
    + f"SELECT rule_id, count(*) AS n FROM ({rules_sql('string_probe', 'artifact_id', expected.STRING_RULES)} UNION ALL {rules_sql('macro_probe', 'artifact_id', expected.MACRO_RULES)} "
    + "UNION ALL SELECT artifact_id, 'E11', 'info', '', part_path FROM part_probe WHERE artifact_id % 3 < 2 "
    + "UNION ALL SELECT artifact_id, 'O10', 'low', '', '' FROM parts WHERE part_path LIKE '%xl/activeX%') GROUP BY rule_id"
)
def u2_union_of_families(spark, d):
    families = [
        rules.apply_rules(table(spark, d, "string_probe")),
        rules.macro_findings(table(spark, d, "macro_probe")),
        rules.encrypted_containers(table(spark, d, "part_probe")),
        ooxml.activex_findings(table(spark, d, "parts")),
    ]
    return findings.union_findings(families).groupBy("rule_id").agg(F.count("*").alias("n"))


def _flagship_sql(k: int) -> str:
    found = rules_sql("strings", "artifact_id, pos", expected.STRING_RULES)
    return (
        cte("mixed")
        + f", strings AS {every('mixed', expected.ASCII_RUN)}, found AS ({found}), kept AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY artifact_id, description ORDER BY pos, indication, rule_id) = 1), "
        + f"counts AS (SELECT artifact_id, {_COUNTS} FROM kept GROUP BY artifact_id) "
        + f"SELECT artifact_id, n_high * 100 + n_medium * 10 + n_low AS score, n_high, n_medium, n_low FROM counts ORDER BY score DESC, artifact_id LIMIT {k}"
    )


@query(_flagship_sql(20))
def flagship_top_risky(spark, d):
    """The documents with the most severe distinct indicators (L3)."""
    found = triage.string_findings(table(spark, d, "mixed")).select("artifact_id", "description", "seq", "indication", "rule_id", "severity")
    return findings.top_risky(findings.dedup_findings(found), 20)


@query(cte("rtf_hex") + "SELECT artifact_id AS root_id, 0::BIGINT AS depth, 'rtf' AS kind FROM rtf_hex UNION ALL SELECT artifact_id, 1::BIGINT, 'ole' FROM rtf_hex WHERE k = 2 AND length(h) > 200")
def c1_triage(spark, d):
    return triage.triage(table(spark, d, "rtf_probe"), 2).select("root_id", "depth", "kind")


def _zip(members: dict[str, bytes]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for path, data in members.items():
            z.writestr(zipfile.ZipInfo(path), data, zipfile.ZIP_DEFLATED)  # without the time: equal members make equal files
    return buffer.getvalue()


def _zipped(rows: DataFrame) -> DataFrame:
    """(artifact_id, t) of containers of the members (artifact_id, ordinal, part_path, t); U1: a path's first member.

    Members are deflated before they are dealt out."""

    @F.arrow_udf("binary")
    def deflated(texts: pa.Array) -> pa.Array:
        return pa.array([zlib.compress(t.encode("latin-1"), 1) for t in texts.to_pylist()], pa.binary())

    def zipped(members: pa.Table) -> pa.Table:
        found = members.sort_by("ordinal").to_pylist()
        data = _zip({r["part_path"]: zlib.decompress(r["data"]) for r in reversed(found)})
        return pa.table({"artifact_id": pa.array([found[0]["artifact_id"]], pa.int64()), "content": pa.array([data], pa.binary())})

    packed = rows.select("artifact_id", "ordinal", "part_path", deflated("t").alias("data"))
    return packed.groupBy("artifact_id").applyInArrow(zipped, "artifact_id long, content binary").select("artifact_id", lens("content").alias("t"))


ROOT_TABLES = ("macro_probe", "rtf_probe", "pdf", "xls", "part_probe", "parts", "string_probe")


def _triage_roots(spark, d) -> DataFrame:
    """Artifacts of every kind from the derived tables, containers zipped from parts; and one container a document that holds them all."""
    tables = []
    for name in ROOT_TABLES:
        rows = table(spark, d, name)
        rows = rows.withColumnRenamed("value", "t") if "value" in rows.columns else rows
        tables.append(_zipped(rows.select("artifact_id", "ordinal", "part_path", "t")) if name == "parts" else rows.select("artifact_id", "t"))
    numbered = [t.select("artifact_id", F.lit(k).cast("bigint").alias("ordinal"), F.lit(f"m{k}.bin").alias("part_path"), "t") for k, t in enumerate(tables)]
    members = numbered[0]
    for t in numbered[1:]:
        members = members.unionByName(t)
    members = written(members, "fixture-members", "zstd")
    single = members.select((F.col("artifact_id") * 8 + F.col("ordinal")).alias("artifact_id"), "t")
    return single.unionByName(_zipped(members).withColumn("artifact_id", F.col("artifact_id") * 8 + 7))


def _triage_sql() -> str:
    """Findings of every family, by rule, severity and depth, from the derived tables alone."""
    ctes = [
        BLOBS,
        f"ole AS (SELECT 0 AS depth, t FROM xls UNION ALL SELECT 1, {OLE} || body FROM rtf_hex WHERE k = 2 AND length(h) > 200 "
        f"UNION ALL SELECT 1, substr(t, instr(t, {OLE})) FROM part_probe WHERE instr(t, {OLE}) > 1)",
        "content AS (SELECT * FROM ole UNION ALL SELECT 0, value FROM macro_probe UNION ALL SELECT 0, t FROM part_probe UNION ALL SELECT 0, value FROM string_probe "
        "UNION ALL SELECT 1, chr(92) || 'rtf1 var x ' || regexp_extract(t, '123 0 obj <</Type /EmbeddedFile>> this.exportDataObject.(.*). endobj', 1) FROM pdf "
        "UNION ALL SELECT 1, t FROM parts WHERE part_path LIKE '%.bin')",
        f"strings AS (SELECT depth, value FROM {every('content', expected.ASCII_RUN, keep='depth')} UNION ALL SELECT depth, replace(value, chr(0), '') FROM {every('content', expected.WIDE_RUN, keep='depth')})",
        f"objects AS (SELECT value AS body FROM {every('pdf', expected.PDF_OBJECT)})",
        _clean("rtf_probe"),
        f"aux AS (SELECT value AS hex, {VALID_HEX} AS ok FROM {every('cleaned', expected.RTF_AUX, 1)} WHERE length(value) > 200 AND artifact_id NOT IN (SELECT artifact_id FROM blobs))",
        "aux_text AS (SELECT hex, coalesce(decode(from_hex(ok), 'replace'), '') AS t FROM aux)",
        "members AS (SELECT artifact_id, part_path, arg_min(t, ordinal) AS t FROM parts GROUP BY ALL)",
        "cells AS (SELECT regexp_extract(t, '<v>([^<]*)</v>', 1) AS value FROM members WHERE part_path LIKE '%worksheets%' UNION ALL SELECT 'inline' FROM members WHERE part_path LIKE '%worksheets%')",
    ]
    flags = [
        ("D2", "/Type ?/EmbeddedFile", "high"), ("D3", "/Type ?/ObjStm", "medium"), ("D8", r"/AA\b", "info"), ("D9", "/OpenAction", "info"), ("D12", "/Launch", "info"), ("D14", "/SubmitForm", "info"),
        ("D4", expected.EXPORT, "high"), ("D6", expected.UNC, "high"), ("D7", "JS [0-9]+ 0 R", "info"), ("D10", "/O [0-9]+ 0 R", "info"), ("D11", "/OpenAction [0-9]+ 0 R", "info"), ("D13", "/GoTo[RE]?", "info"),
    ]
    rels = "CASE " + " ".join(f"WHEN regexp_matches(t, {quoted(p)}) THEN '{r}'" for r, p in expected.RELS) + " END"
    sheets = "chr(133)||chr(0)||chr(14)||chr(0)||chr(92)||chr(0)||chr(0)||chr(0)||chr(2)"
    blob_severity = "CASE rule_id WHEN 'E4' THEN 'high' WHEN 'E9' THEN 'high' ELSE 'medium' END"
    found = [
        f"SELECT rule_id, severity, depth FROM ({rules_sql('strings', 'depth', expected.STRING_RULES)}) WHERE length(description) > 8",
        f"SELECT rule_id, severity, depth FROM ({rules_sql('content', 'depth', expected.MACRO_RULES, v='t')})",
        f"SELECT CASE WHEN c AND p THEN 'E1' WHEN c THEN 'E2' ELSE 'E3' END, CASE WHEN c THEN 'high' ELSE 'info' END, depth FROM (SELECT depth, contains(t, {fixtures._CLSID}) AS c, contains(t, 'Microsoft Equation 3.0') AS p FROM content WHERE length(t) > 50) WHERE c OR p",
        f"SELECT 'E5', 'info', depth FROM content WHERE instr(t, {OLE}) > 1",
        f"SELECT 'E12', 'low', depth FROM content WHERE regexp_matches(t, '{expected.BASE64_RUN}')",
        f"SELECT 'D16', 'high', depth FROM {every('content', chr(92) + 'x13' + chr(92) + 's*DDEAUTO[^' + chr(92) + 'x14]+', keep='depth')}",
        f"SELECT 'J1', 'info', depth FROM ole, {_CLASS_IDS} WHERE contains(t, sig)",
        f"SELECT 'X3', 'high', depth FROM ole WHERE contains(t, {sheets})",
        f"SELECT 'X4', 'info', depth FROM ole WHERE contains(t, {sheets}||chr(1))",
        "SELECT 'X2', 'high', depth FROM ole WHERE contains(t, chr(9)||chr(8)||chr(16)||chr(0)||chr(0)||chr(6)||chr(64))",
        "SELECT 'E6', 'medium', 0 FROM rtf_hex WHERE k = 2 AND length(h) > 200",
        f"SELECT rule_id, {blob_severity}, 0 FROM ({_blob_rules_sql('')})",
        "SELECT 'E7', 'medium', 0 FROM aux_text UNION ALL SELECT 'E4', 'high', 0 FROM aux_text WHERE regexp_matches(t, '(?i)equation') UNION ALL SELECT 'E8', 'medium', 0 FROM aux_text WHERE contains(t, 'Function') OR contains(t, 'Sub ')",
        f"SELECT 'D1', 'medium', 0 FROM {every('pdf', expected.URI)}",
        *[f"SELECT '{r}', '{severity}', 0 FROM objects WHERE regexp_matches(body, '{p}')" for r, p, severity in flags],
        f"SELECT 'D5', CASE WHEN contains(body, 'downl.SettingContent-ms') THEN 'high' ELSE 'info' END, 0 FROM objects WHERE regexp_matches(body, '/Type ?/Filespec') AND regexp_matches(body, '{expected.FILE_REF}')",
        "SELECT 'E10', 'high', 0 FROM pdf UNION ALL SELECT 'D15', 'info', 0 FROM pdf",
        f"SELECT {rels}, CASE WHEN {rels} = 'O2' THEN 'medium' ELSE 'high' END, 0 FROM members WHERE part_path LIKE '%.rels' AND {rels} IS NOT NULL",
        "SELECT 'O5', 'high', 0 FROM members WHERE part_path LIKE '%webSettings%'",
        "SELECT 'O6', 'high', 0 FROM members WHERE part_path LIKE '%document.xml'",
        "SELECT 'O7', 'info', 0 FROM members WHERE part_path LIKE '%workbook.xml'",
        "SELECT 'O8', 'medium', 0 FROM members WHERE part_path LIKE '%worksheets%'",
        "SELECT 'O9', 'info', 0 FROM members WHERE part_path LIKE '%sharedStrings%'",
        "SELECT 'O10', 'low', 0 FROM members WHERE part_path LIKE '%activeX%'",
        "SELECT 'E11', 'info', 0 FROM members WHERE part_path = 'EncryptedPackage'",
        f"SELECT rule_id, severity, 0 FROM ({rules_sql('cells', '1', expected.STRING_RULES)})",
    ]
    tables = cte("macro_probe", "rtf_hex", "rtf_probe", "pdf", "xls", "part_probe", "parts", "string_probe").rstrip()
    return (
        f"{tables}, {', '.join(ctes)}, own(rule_id, severity, depth) AS ({' UNION ALL '.join(found)}), "
        "found AS (SELECT * FROM own UNION ALL SELECT rule_id, severity, depth + 1 FROM own) "  # once by itself, once in the container that holds all
        "SELECT rule_id, severity, depth::BIGINT AS depth, count(*) AS n FROM found GROUP BY ALL"
    )


@query(_triage_sql())
def triage_all_families(spark, d):
    """Every rule of every family over artifacts of all kinds, alone and inside a container: findings by rule, severity and depth."""
    found = triage.triage_all(_triage_roots(spark, d), dedup=None)
    return found.groupBy("rule_id", "severity", "depth").agg(F.count("*").alias("n"))


def _nested_roots(spark, d) -> DataFrame:
    """By turns: a container around a shared container around a shared PDF; the PDF; RTF; OLE around OLE; the shared container."""

    @F.arrow_udf("binary")
    def container(paths: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        """first under a path, and second beside it where there is one."""
        rows = zip(paths.to_pylist(), first.to_pylist(), second.to_pylist(), strict=True)
        return pa.array([_zip({p: a, **({"d.txt": b.encode()} if b is not None else {})}) for p, a, b in rows], pa.binary())

    rows, turn = table(spark, d, "nested"), F.col("artifact_id") % 5
    shared = container(F.lit("word/embeddings/p.bin"), unlens("c"), F.lit(None).cast("string"))
    rows = rows.select("*", shared.alias("shared")).select("*", container(F.lit("in.docx"), F.col("shared"), F.col("body")).alias("whole"))
    t = F.when(turn == 0, lens("whole")).when(turn == 1, F.col("c")).when(turn == 2, F.col("b")).when(turn == 3, F.col("d")).otherwise(lens("shared"))
    return rows.select("artifact_id", t.alias("t"))


_NESTED_SQL = """WITH RECURSIVE {tables},
label AS (SELECT artifact_id AS root_id, CASE artifact_id % 5 WHEN 0 THEN 'w' || g || body WHEN 1 THEN 'c' || g WHEN 2 THEN 'b' || g WHEN 3 THEN 'd' || g ELSE 's' || g END AS node, g FROM nested),
names AS (
  SELECT DISTINCT 'a' || g AS node, 'ole' AS kind, sha256(from_hex(a_hex)) AS sha256 FROM nested UNION SELECT 'b' || g, 'rtf', sha256(b) FROM nested UNION SELECT 'c' || g, 'pdf', sha256(c) FROM nested
  UNION SELECT 'd' || g, 'ole', sha256(from_hex(d_hex)) FROM nested UNION SELECT 's' || g, 'ooxml', NULL FROM nested UNION SELECT node, 'ooxml', NULL FROM label WHERE starts_with(node, 'w')),
holds AS (
  SELECT DISTINCT node AS parent, 's' || g AS child FROM label WHERE starts_with(node, 'w') UNION SELECT 's' || g, 'c' || g FROM nested
  UNION SELECT 'c' || g, 'b' || g FROM nested UNION SELECT 'b' || g, 'a' || g FROM nested UNION SELECT 'd' || g, 'a' || g FROM nested),
reach AS (SELECT root_id, node, 0 AS depth FROM label UNION SELECT root_id, child, depth + 1 FROM reach JOIN holds ON parent = node)
"""


def _nested_sql(select: str) -> str:
    return _NESTED_SQL.format(tables=cte("nested").removeprefix("WITH ").rstrip()) + select


@query(_nested_sql("SELECT root_id, depth::BIGINT AS depth, kind, sha256 FROM reach JOIN names USING (node)"))
def c1_closure(spark, d):
    """What each artifact holds, up to four levels down; a container's digest is left out, as SQL cannot deflate."""
    found = triage.closure(_nested_roots(spark, d)).reached
    return found.select("root_id", "depth", "kind", F.when(F.col("kind") != "ooxml", F.col("sha256")).alias("sha256"))


@query(_nested_sql("SELECT kind, count(DISTINCT node) AS n_opened, count(*) AS n_held FROM reach JOIN names USING (node) GROUP BY kind"))
def c1_opened_once(spark, d):
    """How many contents of each kind were opened, and how often artifacts hold them."""
    corpus = triage.closure(_nested_roots(spark, d))
    held = corpus.reached.groupBy("kind").agg(F.count("*").alias("n_held"))
    return corpus.nodes.groupBy("kind").agg(F.count("*").alias("n_opened")).join(held, "kind").select("kind", "n_opened", "n_held")


_LOSS_SQL = """, kinds AS (SELECT CASE artifact_id % 4 WHEN 0 THEN 'S3 container' WHEN 1 THEN CASE WHEN length(body) > 1000 THEN 'S3 larger than max_bytes' END WHEN 2 THEN 'S4 damaged' ELSE 'C1 deeper than max_depth' END AS loss FROM nested)
SELECT loss, count(*) AS n FROM kinds WHERE loss IS NOT NULL GROUP BY loss"""


@query(cte("nested") + _LOSS_SQL)
def c1_losses(spark, d):
    """What was not read, by reason: cut containers, members beyond the limit, damaged streams, levels beyond the depth asked for."""

    @F.arrow_udf("binary")
    def container(ids: pa.Array, bodies: pa.Array, leaves: pa.Array) -> pa.Array:
        out = []
        for k, body, leaf in zip(ids.to_pylist(), bodies.to_pylist(), leaves.to_pylist(), strict=True):
            data = _zip({"x.bin": body.encode(), "n": str(k).encode()}) if k % 4 < 2 else _zip({"in.docx": _zip({"a.bin": leaf}), "n": str(k).encode()})
            out.append(data[: len(data) // 2] if k % 4 == 0 else data)
        return pa.array(out, pa.binary())

    rows = table(spark, d, "nested")
    broken = F.concat(F.lit("%PDF-1.4 1 0 obj <</Filter /FlateDecode>> stream\nxx"), F.col("artifact_id").cast("string"), F.lit("\nendstream endobj"))
    t = F.when(F.col("artifact_id") % 4 == 2, broken).otherwise(lens(container("artifact_id", "body", unlens("a"))))
    found = triage.triage_all(rows.select("artifact_id", t.alias("t")), max_depth=1, dedup=None, max_bytes=1000).where("rule_id in ('S3', 'S4', 'C1')")
    reason = F.regexp_extract("description", "(larger than max_bytes|damaged|deeper than max_depth|container)", 1)
    return found.groupBy(F.concat_ws(" ", "rule_id", reason).alias("loss")).agg(F.count("*").alias("n"))


# --- streams ---


def _stream_over(spark, d, build, mode: str = "append") -> DataFrame:
    """Runs build over documents as a stream that ends, and reads back what it wrote."""
    base = new_path(spark, "stream")
    path = f"{d}/documents.parquet"
    schema = spark.read.parquet(path).schema
    if spark.read.parquet(path).inputFiles()[0].endswith("/documents.parquet"):  # one file: streams read folders
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(d)
    else:
        rows = spark.readStream.schema(schema).parquet(path)
    timed = rows.select(F.col("doc_id").alias("artifact_id"), F.coalesce("text", F.lit("")).alias("t"), F.timestamp_seconds(F.col("doc_id") % 7200).alias("modificationTime"))
    out = build(timed)
    q = out.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


_STREAMED = f"s AS {every('docs', expected.ASCII_RUN)}, f AS ({rules_sql('s', 'artifact_id, pos', expected.STRING_RULES)})"


@query("WITH " + DOCS + f", {_STREAMED} SELECT artifact_id, pos, rule_id, severity, description FROM f")
def t1_stream_findings(spark, d):
    found = _stream_over(spark, d, stream.stream_findings)
    return longs(found.select("artifact_id", "pos", "rule_id", "severity", "description"))


@query("WITH " + DOCS + f", {_STREAMED} SELECT DISTINCT artifact_id, description FROM f")
def t2_dedup_stream(spark, d):
    found = _stream_over(spark, d, lambda a: stream.dedup_stream(stream.stream_findings(a), "3 hours"))
    return found.select("artifact_id", "description")


@query("WITH " + DOCS + f", {_STREAMED} SELECT to_timestamp((artifact_id % 7200) // 3600 * 3600)::TIMESTAMP AS window_start, rule_id, count(*) AS n FROM f GROUP BY ALL")
def t3_findings_per_window(spark, d):
    timed = docs(spark, d).withColumn("modificationTime", F.timestamp_seconds(F.col("artifact_id") % 7200))
    return stream.findings_per_window(stream.stream_findings(timed)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _in_batches(spark, rows: DataFrame, parts: int, last: DataFrame, build) -> DataFrame:
    """rows as a stream of several batches in no order, and last as its end; what build makes of it, read back.

    By a hash of the row, two parts of three come first, in files of their own: each partition writes
    its rows where they are, and a batch takes the files of one kind.
    """
    base = new_path(spark, "stream")
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == 2
    n_files = []
    for some in (rows.where(~late), rows.where(late), last.coalesce(1)):
        some.write.mode("append").parquet(f"{base}/in", compression="zstd")
        n_files.append(len(spark.read.schema(rows.schema).parquet(f"{base}/in").inputFiles()))
    a_batch = max(parts - 1, n_files[0], n_files[2] - n_files[0])
    before = spark.conf.get(state.STATE_STORE[0])
    spark.conf.set(*state.STATE_STORE)
    try:
        read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", a_batch).parquet(f"{base}/in")
        out = build(read)
        q = out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("compression", "zstd").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        state.run_to_end(q)
    finally:
        spark.conf.set(state.STATE_STORE[0], before)
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(cte("findings") + "SELECT * FROM findings d WHERE NOT EXISTS (SELECT 1 FROM findings e WHERE e.artifact_id = d.artifact_id AND e.seq < d.seq AND (contains(e.description, d.description) OR contains(e.indication, d.description)))")
def t2_contains_stream(spark, d):
    """Findings in no order over several batches, held in state by artifact: what contains mode leaves of the table."""
    rows = table(spark, d, "findings").withColumn("modificationTime", F.timestamp_seconds(100_000 + F.col("artifact_id") % 600 + F.col("seq") * 10))
    end = rows.limit(1).select(*[F.col(c) if c not in ("artifact_id", "modificationTime") else (F.lit(-1).cast("bigint") if c == "artifact_id" else F.timestamp_seconds(F.lit(900_000))).alias(c) for c in rows.columns])
    found = _in_batches(spark, rows, 3, end, lambda r: state.dedup_contains_stream(r, "1 hour"))
    return found.where("artifact_id >= 0")


@query("WITH a AS (SELECT doc_id AS artifact_id, sha256(text) AS value FROM documents WHERE text IS NOT NULL) SELECT value, count(*) - 1 AS n_again FROM a GROUP BY value HAVING count(*) > 1")
def j7_seen_before_stream(spark, d):
    """Digests over several batches: how many artifacts of each came after another with the same content."""
    time = F.timestamp_seconds(100_000 + F.col("doc_id") % 600).alias("modificationTime")
    rows = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("artifact_id"), F.sha2("text", 256).alias("sha256"), time)
    found = _in_batches(spark, rows, 3, rows.limit(0), lambda r: state.seen_before(r, "sha256"))
    return found.groupBy("value").agg(F.countDistinct("artifact_id").alias("n_again"))
