"""Blobs, streams and names as real files have them, and what triage says of files that it cannot read."""

import io
import zipfile
import zlib
from pathlib import Path

from doclens.operators import biff, carve, findings, pdf, rules, triage
from doclens.sources import artifacts as sources
from doclens.sources import tables

OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


def frame(spark, values):
    rows = [(k, v.decode("latin-1") if isinstance(v, bytes) else v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "artifact_id long, t string")


def zipped(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buffer.getvalue()


def test_blobs_keep_their_first_digits(spark):
    head = "0105000002000000" + "0b000000" + b"Equation.3\0".hex() + "ab" * 80
    program = "4d5a" + "0a" * 60 + b"This program".hex() + "00" * 40
    texts = [
        "{\\rtf1 \\objdata " + head + "}", "{\\rtf1 \\objdata\r\n" + head[:50] + "\r\n " + head[50:] + "}", "{\\object{\\*\\objdata}" + head.upper() + "}",
        "{\\rtf1\\objw2160 " + program + "}", "{\\objdata " + head + "7}", "{\\objdata " + "ab" * 100 + "}", "{\\rtf1 plain text, a bad cafe}",
    ]
    blobs = carve.carve_rtf_blobs(frame(spark, texts))
    assert {r.artifact_id: r.hex for r in blobs.collect()} == {0: head, 1: head, 2: head.upper(), 3: program, 4: head}
    from doclens.functions.lens import lens

    found = {(r.artifact_id, r.rule_id) for r in rules.blob_findings(blobs.withColumn("t", lens("content"))).collect()}
    assert found == {(k, "E7") for k in range(5)} | {(k, "E4") for k in (0, 1, 2, 4)} | {(3, "E9")}


def test_streams_end_where_they_say(spark):
    # Deflated data whose last byte is a carriage return, before a bare line end.
    text = next(t for t in (b"y" * k for k in range(1, 300)) if zlib.compress(t)[-1] == 13)
    data = zlib.compress(text)
    inside = zlib.compress(b"a endstream b", 0)
    bodies = [
        b"1 0 obj <</Filter /FlateDecode>> stream\n" + data + b"\nendstream endobj",
        b"1 0 obj <</Filter /FlateDecode /Subtype /application#2Foctet-stream>>\nstream\r\n" + data + b"\r\nendstream endobj",
        b"1 0 obj <</Filter /FlateDecode /Length %d>> stream\n" % len(inside) + inside + b"\nendstream endobj",
        b"1 0 obj <</Filter /FlateDecode>> stream\n" + inside + b"\nendstream endobj",
        b"1 0 obj <</Filter /FlateDecode>> stream\n" + data[:-6] + b"\nendstream endobj",
        b"1 0 obj <</Type /Page>> endobj",
    ]
    objects = frame(spark, bodies).withColumnRenamed("t", "body").selectExpr("artifact_id", "0 AS ordinal", "body")
    found = {r.artifact_id: (bytes(r.content) if r.content is not None else r.problem) for r in pdf.expand_pdf_streams(objects).collect()}
    assert found.pop(4).startswith(("cut short", "damaged"))
    assert found == {0: text, 1: text, 2: b"a endstream b", 3: b"a endstream b"}


def test_sheet_names_by_length(spark):
    def record(name, wide=False):
        data = name.encode("utf-16-le" if wide else "latin-1")
        return b"\x85\x00\x20\x00\x01\x02\x03\x00\x00\x00" + bytes([len(name), int(wide)]) + data

    names = ["A", "TenLetters", "Thirteen char", "x" * 31]
    t = b"".join(record(n, k % 2 == 1) for k, n in enumerate(names)) + b"\x0a\x00\x00\x00"
    assert [r.sheet_name for r in carve.carve_boundsheets(frame(spark, [t])).orderBy("sheet_no").collect()] == names


def test_flags_of_books_with_one_kind_of_record(spark):
    sheets = spark.createDataFrame([(1, 1, "hidden", False, "a")], "artifact_id long, sheet_no long, visibility string, xlm boolean, sheet_name string")
    bofs = spark.createDataFrame([(2, "xlm")], "artifact_id long, substream string")
    found = {r.artifact_id: (r.x3_hidden_sheet, r.x4_xlm_sheet, r.x2_xlm_substream) for r in biff.sheet_flags(sheets, bofs).collect()}
    assert found == {1: (True, False, False), 2: (False, False, True)}


def test_what_triage_cannot_read_is_said(spark):
    deep = OLE + b"powershell -deepest"
    for k in range(6):
        deep = zipped(**{"in.docx" if k else "a.bin": deep, "n": str(k).encode()})
    secret = OLE + b"\0".join(bytes([c]) for c in b"EncryptedPackage") + b"\0\0\0\0" + b"x" * 50
    broken = b"%PDF-1.4 1 0 obj <</Filter /FlateDecode>> stream\nnot deflated\nendstream endobj"
    roots = [deep, zipped(a=b"x")[:40], zipped(**{"big.bin": b"y" * 5000}), broken, secret, b"cmd /c twice powershell"]
    found = triage.triage_all(frame(spark, roots), max_bytes=4000).collect()
    rules_of = {(r.artifact_id, r.depth, r.rule_id) for r in found}
    assert {(0, 6, "I4"), (1, 0, "S3"), (2, 0, "S3"), (3, 0, "S4"), (4, 0, "E11"), (5, 0, "I4")} <= rules_of
    assert {r.description for r in found if r.artifact_id == 2} == {"big.bin: larger than max_bytes"}
    capped = triage.triage_all(frame(spark, roots[:1]), max_depth=2).collect()
    assert [(r.depth, r.rule_id, r.description) for r in capped if r.rule_id == "C1"] == [(2, "C1", "member in.docx: deeper than max_depth")]


def test_no_rule_hides_another(spark):
    found = triage.triage_all(frame(spark, ["powershell cmd /c http://a.test/x", "DOS mode http://b.test"]))
    assert {(r.artifact_id, r.rule_id) for r in found.collect()} == {(0, "I2"), (0, "I4"), (0, "I5"), (0, "V4"), (1, "I2"), (1, "I5"), (1, "I6"), (1, "V4")}
    ordered = [r.rule_id for r in triage.findings.document_order(found.where("artifact_id = 1")).collect()]
    assert ordered == ["I2", "I5", "I6", "V4"]


def test_equal_contents_are_opened_once(spark):
    book = zipped(**{"xl/a.bin": OLE + b"powershell shared"})
    rows = [(k, book.decode("latin-1")) for k in range(5)] + [(None, book.decode("latin-1")), (0, book.decode("latin-1")), (9, "plain"), (9, "other")]
    table = spark.createDataFrame(rows, "artifact_id long, t string")
    corpus = triage.closure(table)
    assert corpus.nodes.groupBy("sha256").count().where("count > 1").count() == 0 and corpus.nodes.count() == 4
    assert corpus.parts.count() == 1 and corpus.reached.where("depth = 1").count() == 6
    assert sorted((r.artifact_id, r.depth) for r in triage.triage_all(table).where("rule_id = 'I4'").collect() if r.artifact_id is not None) == [(k, 1) for k in range(5)]


def test_contains_dedup_of_many_findings(spark):
    rows = [(1, k, "i", f"http://host{k % 700}.test/path/{k % 1400}") for k in range(3000)] + [(1, 5000, "i", "host7.test"), (1, -1, "i", ""), (1, 6000, "i", ""), (2, 0, "i", "host7.test"), (2, 1, None, "host7"), (2, 2, "i", None)]
    df = spark.createDataFrame(rows, "artifact_id long, seq long, indication string, description string")
    left = sorted((r.artifact_id, r.seq) for r in findings.dedup_findings(df, "contains").collect())
    kept, seen = [], {}
    for a, seq, indication, description in sorted(rows, key=lambda r: (r[0], r[1])):
        if description is None or not any(description in t for t in seen.setdefault(a, set())):
            kept.append((a, seq))
        seen.setdefault(a, set()).update(t for t in (indication, description) if t is not None)
    assert left == sorted(kept)


def test_tables_of_a_block_go(spark):
    with tables.temporary_tables(spark):
        path = tables.new_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def test_long_files_are_named(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"short")
    (tmp_path / "b").write_bytes(b"l" * 100)
    scanned = sources.scan_artifacts(spark, f"file://{tmp_path}", max_length=50)
    assert {(r.length, r.problem, r.content is None) for r in scanned.collect()} == {(5, None, False), (100, "larger than max_length", True)}
    assert [(r.rule_id, r.description) for r in triage.triage_all(scanned).collect()] == [("S1", "file: larger than max_length")]


def test_known_contents_are_not_kept_twice(spark):
    """The children of a level go once their digests and what is fresh of them are written; places that repeat make one node."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "doclens"
    before = set(folder.glob("triage-*"))
    ole = "\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    roots = [(k, f"{ole}outer {k % 3}{ole}inner") for k in range(9)] + [(9, f"{ole}inner")]
    corpus = triage.closure(spark.createDataFrame(roots, "artifact_id long, t string"))
    assert corpus.nodes.count() == 4 and corpus.edges.count() == 3 and corpus.reached.where("depth = 1").count() == 9
    assert not [p for p in set(folder.glob("triage-*")) - before if p.name.startswith("triage-children")]
