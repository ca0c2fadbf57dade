"""Tables derived from documents that hold inert markers of every operator, in Spark and in DuckDB alike.

Each table is one SQL select over documents; only how BODY is made differs between engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from doclens.sources.artifacts import spread

OLE = "chr(208)||chr(207)||chr(17)||chr(224)||chr(161)||chr(177)||chr(26)||chr(225)"
BS = "chr(92)"
NUL = "chr(0)"


def _bytes(*values: int) -> str:
    return "||".join(f"chr({v})" for v in values)


# In Spark each text is read once, as runs of what stays rather than by replacing what goes, and behind a generator, so that
# no row or expression that holds it makes it again.
_MADE = (
    "(SELECT documents.*, made.body FROM documents LATERAL VIEW "
    "explode(array(array_join(regexp_extract_all(coalesce(text, ''), '[A-Za-z ]+', 0), ''))) made AS body) AS documents"
)


def _text(sql: str, engine: str) -> str:
    """Fills in BODY: the letters and spaces of a whole document."""
    if engine == "spark":
        return re.sub(r"\bBODY\b", "body", sql.replace("FROM documents", f"FROM {_MADE}")) if re.search(r"\bBODY\b", sql) else sql
    return re.sub(r"\bBODY\b", "regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g')", sql)


# Every fifth header is of version 4 with sectors of 4096 bytes.
_HEADER = (
    f"{OLE}||repeat({NUL}, 16)||{_bytes(62, 0)}||CASE WHEN doc_id % 5 = 1 THEN chr(4) ELSE chr(3) END||{_bytes(0, 254, 255)}"
    f"||CASE WHEN doc_id % 5 = 1 THEN chr(12) ELSE chr(9) END||{_bytes(0)}||repeat({NUL}, 480)"
)
_BOF = "chr(9)||chr(8)||chr(16)||chr(0)||chr(0)||chr(6)||chr({kind})||chr(0)||chr(1)||chr(2)||chr(3)||chr(4)"


def _bof(kind: int) -> str:
    return _BOF.format(kind=kind)


def _sheet(offset: int, visibility: str, xlm: str, name: str = "'S'||lpad(cast(doc_id AS VARCHAR(20)), 6, '0')", size: int = 7) -> str:
    return f"{_bytes(133, 0, 14, 0, offset, 0, 0, 0)}||{visibility}||{xlm}||{_bytes(size, 0)}||{name}"


def _unless_plain(value: int) -> str:
    """A byte that is 0 in every fifth workbook: one without hidden sheets and macros."""
    return f"CASE WHEN doc_id % 5 = 0 THEN chr(0) ELSE chr({value}) END"


# A name that no sheet may have, in every seventh workbook.
_ODD_NAME = "CASE WHEN doc_id % 7 = 3 THEN 'S?'||lpad(cast(doc_id AS VARCHAR(20)), 5, '0') ELSE 'S'||lpad(cast(doc_id AS VARCHAR(20)), 6, '0') END"
# Ten characters: their number is the first byte of an end mark.
_TEN = "'T'||lpad(cast(doc_id AS VARCHAR(20)), 9, '0')"
_EOF = _bytes(10, 0, 0, 0)
XLS = (
    f"SELECT doc_id AS artifact_id, {_HEADER}||'Microsoft Excel'||{_bof(5)}||{_sheet(76, 'chr(0)', 'chr(0)')}"
    f"||{_sheet(92, _unless_plain(2), _unless_plain(1), _ODD_NAME)}||{_sheet(108, _unless_plain(1), 'chr(0)', _TEN, 10)}"
    f"||{_EOF}||{_bof(16)}||{_EOF}||CASE WHEN doc_id % 5 = 0 THEN {_bof(16)} ELSE {_bof(64)} END||{_EOF}||{_bof(16)}||{_EOF} AS t FROM documents"
)

_PDF = (
    "'%PDF-1.4'||chr(10)||'1 0 obj <</Type /Catalog /'||CASE WHEN doc_id % 7 = 0 THEN 'OpenAct' ELSE 'OpenAction' END||' 3 0 R /'||CASE WHEN doc_id % 3 = 0 THEN 'AX' ELSE 'AA' END"
    "||' /'||CASE WHEN doc_id % 5 = 0 THEN 'JX' ELSE 'JS' END||' 3 0 R /O 77 0 R>> endobj'||chr(10)"
    "||'3 0 obj <</'||CASE WHEN doc_id % 4 = 0 THEN 'Lunch' ELSE 'Launch' END||' /URI (http://u'||cast(doc_id % 50 AS VARCHAR(20))||'.test) /URI(https://b.test)>> stream '||BODY||' endstream endobj'||chr(10)"
    "||'12 0 obj <</GoToR /SubmitForm /AAx>> endobj'||chr(10)"
    "||'123 0 obj <</Type /EmbeddedFile>> this.exportDataObject('||BODY||') endobj'||chr(10)"
    "||'5 0 obj <</Type /Filespec /F (downl.SettingContent-ms)>> /Type /ObjStm endobj'||chr(10)"
    "||'6 0 obj <</Type/Filespec /F (plain.txt) /F(' || " + f"{BS}||{BS}||'10.1.2.3'||{BS}||'share)>> endobj'||chr(10)"
    "||'7 0 obj <</Filter /ASCIIHexDecode>> stream '||lower(hex(" + f"{BS}||'rtf1 var x '||BODY" + "))||' endstream endobj'"
)
PDF = f"SELECT doc_id AS artifact_id, {_PDF} AS t FROM documents"

_MIXED = [
    "BODY||' http://h'||cast(doc_id % 50 AS VARCHAR(20))||'.test/p.exe powershell'",
    f"'{{'||{BS}||'rtf1 }}'||'d0cf11e0a1b11ae1'||lower(hex(BODY))||'}}'",
    _PDF,
    f"{_HEADER}||'Microsoft Excel'||{_bof(5)}",
    """'<Relationships><Relationship Type="attachedTemplate" Target="http://t'||cast(doc_id % 50 AS VARCHAR(20))||'.test" TargetMode="External"/></Relationships>'""",
    "'<sst><si><t>'||BODY||'</t></si><si><t>two</t></si></sst>'",
    """'Attribute VB_Name = "M"'||chr(10)||'Sub Auto_Open()'||chr(10)||'Shell("cmd /c '||BODY||'")'""",
    "'plain '||BODY",
]
MIXED = (
    "SELECT doc_id AS artifact_id, doc_id % 8 AS kind_no, CASE doc_id % 8 "
    + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(_MIXED))
    + " END AS t FROM documents"
)


def _probe(tokens: list[str], bare: int = -1) -> str:
    """Whole texts with a token each; the token of number bare stands alone."""
    cases = " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(tokens))
    return f"SELECT doc_id AS artifact_id, 'p' AS part_path, doc_id % {len(tokens)} AS k, CASE doc_id % {len(tokens)} WHEN {bare} THEN '' ELSE BODY||' ' END||(CASE doc_id % {len(tokens)} {cases} END) AS value FROM documents"


STRING_PROBE = _probe(
    ["'URLMON'", "'http://a.test/x'", "'CreateFile'", "'cmd /c dir'", "'p.exe'", "'DOS mode'", "'Equation'", "'http://a.microsoft.test/x'", "'kernel32.dll'", "repeat('x.exe', 24)", "'none here'", "repeat('QUJD', 20)"],
    bare=4,
)
MACRO_PROBE = _probe(
    ["'Document_Open'", "'Auto_Close'", "'WScript.Shell'", "'\"http://a.test/b/c\"'", "'FORMULA('", "'Option Explicit'", "'http alone'", "chr(0)||'Attribut'||chr(0)||'e '", "'Sub x Function abc_'||cast(doc_id % 5 AS VARCHAR(20))",
     "chr(10)||'Attribute VB_Name = 1'"]
)
_CLSID = _bytes(2, 206, 2, 0, 0, 0, 0, 0, 192, 0, 0, 0, 0, 0, 0, 70)
# A shortcut's class id in the order of the bytes on disk, and a script moniker's in text order.
_SHORTCUT = _bytes(1, 20, 2, 0, 0, 0, 0, 0, 192, 0, 0, 0, 0, 0, 0, 70)
_MONIKER = _bytes(6, 41, 11, 211, 72, 170, 17, 210, 132, 50, 0, 96, 8, 195, 251, 252)
PART_PROBE = (
    "SELECT doc_id AS artifact_id, CASE doc_id % 3 WHEN 0 THEN 'EncryptedPackage' WHEN 1 THEN 'root/Encryption/data' ELSE 'WordDocument' END AS part_path, "
    f"CASE doc_id % 6 WHEN 0 THEN BODY||'Microsoft Equation 3.0'||{_CLSID} WHEN 1 THEN BODY||{_CLSID} WHEN 2 THEN BODY||'Microsoft Equation 3.0' "
    f"WHEN 3 THEN 'Microsoft Equation 3.0' WHEN 4 THEN BODY||{OLE}||BODY||{_MONIKER} ELSE BODY||{_SHORTCUT}||chr(19)||' DDEAUTO cmd '||BODY||chr(20) END AS t FROM documents"
)
# What the hex of an RTF file says, before it is put there: by turns an OLE1 head with an equation, a script, an OLE file, a program.
RTF_HEX = (
    "SELECT doc_id AS artifact_id, doc_id % 4 AS k, BODY AS body, CASE doc_id % 4 "
    "WHEN 0 THEN '01050000020000000b000000'||lower(hex('Equation.3'||chr(0)||BODY)) WHEN 1 THEN lower(hex('Function abc Sub '||BODY))||'0' "
    "WHEN 2 THEN 'd0cf11e0a1b11ae1'||lower(hex(BODY)) ELSE '4d5a'||repeat('0a', 60)||'546869732070726f6772616d'||repeat('20', 60) END AS h FROM documents"
)
# After a control word and its blank, or after a group; with a line end among the digits, or none.
RTF_PROBE = (
    f"SELECT artifact_id, '{{'||{BS}||'rtf1 '||CASE WHEN artifact_id % 8 < 4 THEN {BS}||'objdata ' ELSE {BS}||'objupdate{{'||{BS}||'*'||{BS}||'objdata}}'||chr(10) END"
    f"||left(h, 64)||CASE WHEN artifact_id % 3 = 0 THEN chr(13)||chr(10) ELSE '' END||substr(h, 65)||'}}' AS t FROM ({RTF_HEX}) AS hexes"
)
AUX_PROBE = "SELECT doc_id AS artifact_id, '{q z'||lower(hex(BODY))||'{' AS t FROM documents"
WIDE_PROBE = (
    "SELECT doc_id AS artifact_id, chr(1)||regexp_replace(BODY, '(.)', CHARWISE)||chr(1)||repeat('QUJD', 20)||chr(1)||repeat('QUJD', 5) AS t FROM documents"
)

_PARTS = [
    ("word/document.xml", "'<w><p><r><instrText>DDEAUTO cmd '||BODY||'</instrText></r></p></w>'"),
    ("xl/worksheets/sheet1.xml", "'<s><sheetData><row><c r=\"A1\"><v>'||BODY||' http:x</v></c><c r=\"B1\"><v>7</v></c><c r=\"C1\" t=\"inlineStr\"><is><t>inline</t></is></c></row></sheetData><oleObjects>a</oleObjects></s>'"),
    ("xl/sharedStrings.xml", "'<sst><si><t xml:space=\"preserve\"/></si><si><t>'||BODY||'x</t></si><si><r><t>rich</t></r></si></sst>'"),
    ("_rels/.rels", "RELS"),
    ("xl/activeX/a.bin", "BODY"),
    ("xl/webSettings.xml", "'<Relationships><Relationship Type=\"frame\" Target=\"http://f.test\" TargetMode=\"External\"/></Relationships>'"),
    ("xl/workbook.xml", "'x>&lt;'||BODY"),
    ("_rels/.rels", "'second'"),
    ("ppt/slides/slide1.xml", "'<p>'||BODY||'</p>'"),
    ("EncryptedPackage", "BODY"),
]
_RELS = (
    "'<Relationships><Relationship Type=\"'||CASE doc_id % 5 "
    "WHEN 0 THEN 'oleObject\" Target=\"mhtml:http://m.test\" TargetMode=\"External\"/>' "
    "WHEN 1 THEN 'attachedTemplate\" Target=\"http://t.test\" TargetMode=\"External\"/>' "
    "WHEN 2 THEN 'hyperlink\" Target=\"http://h.test\" TargetMode=\"External\"/>' "
    "WHEN 3 THEN 'oleObject\" TargetMode=\"External\" Target=\"http://o.test\"/>' "
    "ELSE 'hyperlink\" Target=\"http://i.test\" TargetMode=\"Internal\"/>' END||'</Relationships>'"
)


def _several(columns: str, n: int) -> str:
    """n rows of columns for each document, numbered k, whose text is read once; BODY is made before it is repeated."""
    rows = ", ".join(f"({k})" for k in range(n))
    return f"SELECT {columns.replace('BODY', 'body')} FROM (SELECT doc_id, BODY AS body FROM documents) AS d CROSS JOIN (VALUES {rows}) AS v(k)"


def _by_number(values: list[str]) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


PARTS = _several(
    "doc_id AS artifact_id, cast((doc_id + k * 7) % 3 * 10 + k AS BIGINT) AS ordinal, "
    + _by_number([f"'{path}'" for path, _ in _PARTS]) + " AS part_path, " + _by_number([t.replace("RELS", _RELS) for _, t in _PARTS]) + " AS t",
    len(_PARTS),
)
# Workbooks as real ones are: prefixes, references, CDATA, runs with their sounds, cells that name strings; every fifth list
# of strings and every seventh sheet is cut short.
_STRING_LIST = (
    "'<?xml version=\"1.0\" encoding=\"UTF-8\"?><x:sst xmlns:x=\"http://a.test\" count=\"4\"><x:si><x:t xml:space=\"preserve\"> a &amp; &#112;owershell '||BODY||'</x:t></x:si><x:si/>'"
    "||'<x:si><x:r><x:rPr><x:b/></x:rPr><x:t>'||BODY||'</x:t></x:r><x:r><x:t>-rich</x:t></x:r><x:rPh sb=\"0\"><x:t>sound</x:t></x:rPh></x:si>'"
    "||'<x:si><x:t><![CDATA[<'||BODY||'&amp;>]]>z</x:t></x:si>'||CASE WHEN doc_id % 5 = 0 THEN '' ELSE '</x:sst>' END"
)
_CELLS = (
    "'<ws><sheetData><row r=\"1\"><c r=\"A1\" t=\"s\"><v>0</v></c><c t=\"s\" r=\"B1\"><v>2</v></c><c r=\"C1\" t=\"s\"><v>3</v></c></row><row/>'"
    "||'<row><c r=\"D2\" t=\"s\"><v>1</v></c><c r=\"E2\" t=\"s\"><v>99</v></c><c r=\"F2\" s=\"1\"/><c r=\"G2\" t=\"inlineStr\"><is><r><t>in</t></r><r><t>line&#x41;</t></r></is></c>'"
    "||'<c r=\"H2\" t=\"str\"><f>A1</f><v>x&lt;'||BODY||'</v></c><c r=\"I2\"><v>7</v></c></row>'||CASE WHEN doc_id % 7 = 0 THEN '' ELSE '</sheetData></ws>' END"
)
XML_PARTS = _several(
    "doc_id AS artifact_id, cast(k AS BIGINT) AS ordinal, "
    + _by_number(["'xl/sharedStrings.xml'", "'xl/worksheets/sheet1.xml'", "'xl/macrosheets/sheet1.xml'"]) + " AS part_path, "
    + _by_number([_STRING_LIST, _CELLS, "'<m:s xmlns:m=\"http://m.test\"><m:sheetData><m:row><m:c r=\"A1\" t=\"str\"><m:v>=EXEC(&quot;cmd '||BODY||'&quot;)</m:v></m:c></m:row></m:sheetData></m:s>'"]) + " AS t",
    3,
)
_FINDINGS = [
    ("'seen'", "'long '||BODY||' tail'", "high"),
    ("'part'", "'long '||BODY", "medium"),
    ("'again'", "'long '||BODY||' tail'", "low"),
    ("'note '||BODY||' end'", "'other '||cast(doc_id % 7 AS VARCHAR(20))", "info"),
    ("'inner'", "'note '||BODY", "medium"),
]
FINDINGS = _several(
    "doc_id AS artifact_id, cast(k AS BIGINT) AS seq, 'R'||cast((doc_id + k) % 4 AS VARCHAR(20)) AS rule_id, "
    + ", ".join(f"{_by_number(values)} AS {name}" for name, values in (
        ("indication", [i for i, _, _ in _FINDINGS]), ("description", [d for _, d, _ in _FINDINGS]), ("severity", [f"'{s}'" for _, _, s in _FINDINGS]),
    )),
    len(_FINDINGS),
)
# Files that hold each other, seven of each kind shared by all documents: (a) an OLE file, (b) RTF with its hex, (c) PDF with
# that in hex, (d) an OLE file around (a). Text with its bytes as characters, and in hex.
_LEAF = "'shared leaf '||cast(doc_id % 7 AS VARCHAR(20))||repeat(' powershell cmd', 20)"
_LEAF_HEX = f"'d0cf11e0a1b11ae1'||lower(hex({_LEAF}))"
_RTF = f"'{{'||{BS}||'rtf1 '||{BS}||'objdata '||{_LEAF_HEX}||'}}'"
NESTED = (
    f"SELECT doc_id AS artifact_id, doc_id % 7 AS g, {OLE}||{_LEAF} AS a, {_RTF} AS b, "
    f"'%PDF-1.4 1 0 obj <</Filter /ASCIIHexDecode>> stream '||lower(hex({_RTF}))||' endstream endobj' AS c, "
    f"{OLE}||'outer '||{OLE}||{_LEAF} AS d, {_LEAF_HEX} AS a_hex, 'd0cf11e0a1b11ae1'||lower(hex('outer '))||{_LEAF_HEX} AS d_hex, BODY AS body FROM documents"
)
BODIES = "SELECT doc_id AS artifact_id, BODY AS body FROM documents"
TABLES = {
    "bodies": BODIES,
    "xls": XLS, "pdf": PDF, "mixed": MIXED, "string_probe": STRING_PROBE, "macro_probe": MACRO_PROBE, "part_probe": PART_PROBE,
    "rtf_hex": RTF_HEX, "rtf_probe": RTF_PROBE, "nested": NESTED, "aux_probe": AUX_PROBE, "wide_probe": WIDE_PROBE, "parts": PARTS, "xml_parts": XML_PARTS, "findings": FINDINGS,
}


def sql_of(name: str, engine: str) -> str:
    sql = TABLES[name]
    # Each character followed by a zero byte: the replacement names its group differently.
    sql = sql.replace("CHARWISE", f"'$1'||{NUL}" if engine == "spark" else f"'\\1'||{NUL}, 'g'")
    return _text(sql, engine)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the documents of sf_dir."""
    spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).createOrReplaceTempView("documents")
    return spark.sql(sql_of(name, "spark"))


def cte(*names: str) -> str:
    """The derived tables as the head of a DuckDB query."""
    return "WITH " + ", ".join(f"{n} AS ({sql_of(n, 'duckdb')})" for n in names) + "\n"
