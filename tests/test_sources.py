"""Directories, archives, the sink, and streams against batches."""

import io
import uuid
import warnings
import zipfile
import zlib

from pyspark.sql import functions as F

from doclens.operators import rules, triage
from doclens.sources import artifacts as sources
from doclens.streaming import stream


def _zip(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z, warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for name, data in members:
            z.writestr(name, data)
    return buffer.getvalue()


def test_expand_archives(spark):
    good = _zip([("a.xml", "one"), ("b/c.bin", "two"), ("a.xml", "again"), ("big", "x" * 2000)])
    rows = [(1, good), (2, good[: len(good) // 2]), (3, b""), (4, None)]
    out = sources.expand_archives(spark.createDataFrame(rows, "artifact_id long, content binary"), max_bytes=1000).collect()
    kept = {(r.artifact_id, r.part_path): bytes(r.content) for r in out if r.content is not None}
    assert set(kept) == {(1, "a.xml"), (1, "b/c.bin")} and kept[1, "b/c.bin"] == b"two"
    assert {(r.artifact_id, r.part_path) for r in out if r.problem} == {(1, "big"), (2, None), (3, None), (4, None)}


def test_expand_archives_member_limit(spark):
    df = spark.createDataFrame([(1, _zip([(f"m{k}", "x") for k in range(5)]))], "artifact_id long, content binary")
    out = sources.expand_archives(df, max_parts=3).collect()
    assert sum(r.content is not None for r in out) == 3 and sum(r.problem is not None for r in out) == 1


def test_scan_stream_and_sink(spark, tmp_path):
    files = tmp_path / "in" / "deep"
    files.mkdir(parents=True)
    (files / "a.txt").write_bytes(b"fetch http://a.test/x.exe now \xff")
    (files / "b.txt").write_bytes(b"nothing to see")
    (files / "c.skip").write_bytes(b"powershell powershell")
    scanned = sources.scan_artifacts(spark, f"file://{tmp_path}/in", "*.txt")
    assert scanned.count() == 2 and scanned.where("length > 20").count() == 1
    batch = {(r.artifact_id, r.rule_id, r.description) for r in triage.string_findings(scanned).collect()}
    q = stream.triage_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp", dedup=False)
    q.awaitTermination()
    streamed = spark.read.parquet(f"file://{tmp_path}/out").where("description not like '%powershell powershell%'")
    assert {(r.artifact_id, r.rule_id, r.description) for r in streamed.collect()} == batch and batch
    sources.write_findings(triage.string_findings(scanned), f"file://{tmp_path}/findings")
    assert spark.read.parquet(f"file://{tmp_path}/findings").where("severity = 'medium'").count() == len([b for b in batch if b[1] in ("I2", "I4", "I5")])


def test_dedup_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"cmd /c one\x00cmd /c one\x00cmd /c two")
    q = stream.triage_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination()
    assert sorted(r.description for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["cmd /c one", "cmd /c two"]


def test_rule_with_null_and_long_values(spark):
    df = spark.createDataFrame([(1, None), (2, "a.exe" + "x" * 200), (3, "a.exe"), (4, "")], "artifact_id long, value string")
    assert [(r.artifact_id, r.rule_id) for r in rules.apply_rules(df).collect()] == [(3, "I5")]


def test_windows_of_findings(spark):
    df = spark.createDataFrame([(1, "I1", 10), (2, "I1", 20), (3, "I2", 4000)], "artifact_id long, rule_id string, s long")
    out = stream.findings_per_window(df.withColumn("modificationTime", F.timestamp_seconds("s"))).collect()
    assert sorted((r.rule_id, r.n) for r in out) == [("I1", 2), ("I2", 1)]


def test_triage_of_zip_pdf_and_ole_roots(spark):
    ole = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"

    def docx(members):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in members:
                z.writestr(name, data)
        return buffer.getvalue()

    macro, sheet = ole + b"macro " * 50, ole + b"sheet " * 50
    inner = docx([("xl/embeddings/oleObject1.bin", b"head" + sheet), ("xl/workbook.xml", b"<x/>")])
    stream_ = b"4 0 obj <</Filter /FlateDecode>> stream\r\n" + zlib.compress(ole + b"in pdf") + b"\r\nendstream endobj"
    roots = [docx([("word/vbaProject.bin", macro), ("word/document.xml", b"<w/>"), ("word/embeddings/a.xlsx", inner)]), b"%PDF-1.4\n" + stream_, ole + b"a" + ole + b"b", docx([("a", b"b")])[:40]]
    table = spark.createDataFrame([(k, r.decode("latin-1")) for k, r in enumerate(roots)], "artifact_id long, t string")
    found = {(r.root_id, r.depth, r.kind, r.t.encode("latin-1")) for r in triage.triage(table, 3).where("depth > 0").collect()}
    assert found == {
        (0, 1, "ole", macro), (0, 1, "ooxml", inner), (0, 2, None, b"head" + sheet), (0, 3, "ole", sheet),
        (1, 1, "ole", ole + b"in pdf"), (2, 1, "ole", ole + b"b"),
    }


def lens_of(*rows):
    return [(k, r.decode("latin-1") if r is not None else None) for k, r in enumerate(rows)]


def test_triage_all_kinds(spark):
    ole = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    clsid = uuid.UUID("F414C260-6AC0-11CF-B6D1-00AA00BBBB58").bytes_le

    def container(members):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in members:
                z.writestr(name, data)
        return buffer.getvalue()

    book = container([
        ("xl/sharedStrings.xml", b"<sst><si><t xml:space='preserve'/></si><si><t>one</t></si></sst>"),
        ("xl/worksheets/sheet1.xml", b'<s><c r="A1"/><c r="B2" t="inlineStr"><is><t>http://cell.test</t></is></c><c r="C3"><f>1</f><v>powershell</v></c></s>'),
        ("xl/embeddings/a.bin", b"x" + ole + b"first powershell -x " + ole + b"second " + clsid),
        ("EncryptedPackage", b""),
    ])
    roots = [book, b"plain cmd /c run " + b"QUJD" * 20, b"%PDF-1.4 1 0 obj <</Launch>> endobj", b"{\\rtf1 \\o " + (ole + b"Equation " * 20).hex().encode() + b"}", None, b"", b"nothing"]
    table = spark.createDataFrame(lens_of(*roots), "artifact_id long, t string")
    found = {(r.artifact_id, r.depth, r.rule_id, r.description) for r in triage.triage_all(table).collect()}
    rule = {(a, d, r) for a, d, r, _ in found}
    assert {(0, 0, "O9"), (0, 0, "I2"), (0, 0, "I4"), (0, 0, "E11"), (1, 0, "I4"), (1, 0, "E12"), (2, 0, "D12"), (3, 0, "E6"), (3, 0, "E7"), (3, 0, "E4")} <= rule
    assert {(0, 2, "E5"), (0, 2, "J1")} <= rule and (0, 0, "O9", "one") in found and (0, 0, "I2", "http://cell.test") in found
    assert not {a for a, _, _, _ in found} & {4, 5, 6}
    assert len([f for f in found if f[0] == 2]) == 1
    empty = spark.createDataFrame([], "artifact_id long, t string")
    assert triage.triage_all(empty).count() == 0
    every = triage.triage_all(table, dedup=None)
    assert every.count() >= len(found) and triage.findings.top_risky(triage.triage_all(table)).first().artifact_id in (0, 3)


def test_sheet_findings_need_their_marks(spark):
    sheets = spark.createDataFrame([(1, 1, "visible", False, "a"), (1, 2, "hidden", False, "b"), (1, 3, "very hidden", True, "c"), (2, 1, "visible", False, "d")], "artifact_id long, sheet_no long, visibility string, xlm boolean, sheet_name string")
    bofs = spark.createDataFrame([(1, "globals"), (2, "worksheet"), (3, "xlm")], "artifact_id long, substream string")
    found = sorted((r.artifact_id, r.rule_id, r.description) for r in triage.biff.sheet_findings(sheets, bofs).collect())
    assert found == [(1, "X3", "b, c"), (1, "X4", "c"), (3, "X2", "1")]


def test_stream_of_all_families_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"see cmd /c one now")
    (tmp_path / "in" / "b").write_bytes(b"%PDF-1.4 1 0 obj <</Launch>> endobj")
    q = stream.triage_all_stream(stream.artifact_stream(spark, f"file://{tmp_path}/in", files_per_batch=1), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination()
    streamed = {(r.artifact_id, r.rule_id, r.description) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    batch = triage.triage_all(sources.scan_artifacts(spark, f"file://{tmp_path}/in"))
    assert streamed == {(r.artifact_id, r.rule_id, r.description) for r in batch.collect()} and {r for _, r, _ in streamed} == {"I4", "D12"}


def test_late_findings_are_dropped(spark, tmp_path):
    """T3 with a watermark: what comes later than the delay after newer data is not counted."""
    (tmp_path / "in").mkdir()
    schema = "artifact_id long, rule_id string, s long"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")

    def run():
        rows = spark.readStream.schema(schema).json(f"file://{tmp_path}/in").withColumn("modificationTime", F.timestamp_seconds("s"))
        counted = stream.findings_per_window(rows, "1 hour", "1 hour")
        q = counted.writeStream.format("parquet").outputMode("append").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    put("a", [(1, "I1", 10), (2, "I1", 20), (3, "I1", 20_000)])
    run()
    put("b", [(4, "I1", 30), (5, "I1", 40_000)])  # 30 is hours before 20000
    run()
    found = {r.window_start.hour: r.n for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert found[0] == 2 and found[5] == 1
