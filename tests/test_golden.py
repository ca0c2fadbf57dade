"""A positive and a negative string for what the survey lists as defects, and edge cases of operators."""

import pytest
from pyspark.sql import functions as F

from doclens.operators import biff, carve, findings, ooxml, pdf, rules, triage


def frame(spark, values, name="t"):
    return spark.createDataFrame(list(enumerate(values)), f"artifact_id long, {name} string")


def hits(df):
    return sorted({(r.artifact_id, r.rule_id) for r in df.collect()})


def test_equation_words(spark):
    found = hits(rules.apply_rules(frame(spark, ["xx EQUATION", "nnnnnnnn", "equatio n"], "value"), rules.STRING_RULES[6:]))
    assert found == [(0, "I7")]


def test_exclusions_suppress_the_whole_string(spark):
    assert hits(rules.apply_rules(frame(spark, ["http://a.test", "http://a.test microsoft"], "value"), rules.STRING_RULES[1:2])) == [(0, "I2")]


def test_pdf_numbers_uris_and_actions(spark):
    t = "123 0 obj <</JS 45 0 R /OpenAction 6 0 R /GoToE>> URI (http://a) URI(http://b) endobj 6 0 obj /F(\\\\10.0.0.1\\x) endobj"
    objects = carve.carve_pdf_objects(frame(spark, [t]))
    assert [r.obj_no for r in objects.orderBy("ordinal").collect()] == [123, 6]
    found = pdf.object_findings(objects).collect()
    assert sorted(r.description for r in found if r.rule_id == "D1") == ["URI (http://a)", "URI(http://b)"]
    assert [r.description for r in found if r.rule_id == "D13"] == ["/GoToE"]
    assert [r.description for r in found if r.rule_id == "D6"] == ["F(\\\\10.0.0.1\\x)"]
    refs = {(r.kind, r.dst_obj): r.dst_ordinal for r in pdf.resolve_pdf_refs(pdf.pdf_refs(objects), objects).collect()}
    assert refs == {("js", 45): None, ("open_action", 6): 1}


def test_relationships_on_one_line_stay_apart(spark):
    t = '<a hyperlink" Target="x" TargetMode="External"/><b hyperlink" Target="y" TargetMode="External"/>'
    parts = spark.createDataFrame([(1, 0, "_rels/a.rels", t)], "artifact_id long, ordinal int, part_path string, t string")
    assert len(ooxml.carve_rels(parts).collect()) == 2
    assert [r.rule_id for r in ooxml.rels_findings(parts).collect()] == ["O3"]


def test_damaged_xml_is_no_error(spark):
    parts = spark.createDataFrame([(1, 0, "xl/sharedStrings.xml", "<sst><si><t>a &amp; b</t><t"), (2, 0, "xl/sharedStrings.xml", None)], "artifact_id long, ordinal int, part_path string, t string")
    assert [r.value for r in ooxml.xml_shared_strings(parts).orderBy("artifact_id").collect()] == ["a & b", None]


def test_macro_url_without_quotes(spark):
    found = rules.macro_findings(frame(spark, ["x http alone", 'see "https://a.test/b"'], "value")).where("rule_id = 'V4'")
    assert {r.artifact_id: r.description for r in found.collect()} == {0: "http", 1: 'https://a.test/b"'}


def test_dedup_modes(spark):
    rows = [(1, 0, "i", "long text"), (1, 1, "i", "long"), (1, 2, "holds word", "z"), (1, 3, "i", "word"), (1, 4, "i", "long text"), (2, 0, "i", "long")]
    df = spark.createDataFrame(rows, "artifact_id long, seq long, indication string, description string")
    assert sorted((r.artifact_id, r.seq) for r in findings.dedup_findings(df).collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    assert sorted((r.artifact_id, r.seq) for r in findings.dedup_findings(df, "contains").collect()) == [(1, 0), (1, 2), (2, 0)]
    with pytest.raises(ValueError):
        findings.dedup_findings(df, "other")


def test_wide_strings_are_whole(spark):
    t = "".join(c + "\0" for c in "hello world") + "\1" + "a\0b\0"
    assert [r.value for r in carve.carve_wide(frame(spark, [t])).collect()] == ["hello world"]


def test_last_sheet_ends_with_the_file(spark):
    placed = spark.createDataFrame([(1, 1, 10), (1, 2, 30)], "artifact_id long, sheet_no long, bof_at long")
    lengths = spark.createDataFrame([(1, 50)], "artifact_id long, length long")
    assert [(r.sheet_no, r.size) for r in biff.next_sheet(placed, lengths).orderBy("sheet_no").collect()] == [(1, 20), (2, 20)]


def test_triage_depth_and_cycles(spark):
    inner = bytes.fromhex("D0CF11E0A1B11AE1") + b"x" * 200
    t = "{\\rtf1 " + inner.hex() + "}"
    out = triage.triage(frame(spark, [t, "plain"]), 3)
    assert sorted((r.root_id, r.depth, r.kind) for r in out.collect()) == [(0, 0, "rtf"), (0, 1, "ole"), (1, 0, None)]
    assert triage.triage(frame(spark, [t]), 0).count() == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "artifact_id long, t string")
    assert carve.carve_strings(empty).count() == 0
    assert triage.flagship(empty).count() == 0
    assert triage.triage(empty).count() == 0
    assert carve.carve_bof(empty.withColumn("x", F.lit(1))).count() == 0
