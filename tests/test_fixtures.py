"""The derived tables in Spark: each text's letters are made once, and are the same as by replacement."""

import re

from doclens.plans import fixtures

TEXTS = ["Ab c\n1,2", "", None, "äöü déjà \U0001f600 x", "...", "plain words only", "a\tb\r\nc\x00d", "  "]


def test_bodies_made_once(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["artifact_id"]: r["body"] for r in fixtures.table(spark, str(tmp_path), "bodies").collect()}
    assert found == {k: re.sub("[^A-Za-z ]", "", t or "") for k, t in enumerate(TEXTS)}
    for name in ("findings", "parts", "xml_parts"):
        table = fixtures.table(spark, str(tmp_path), name)
        plan = table._jdf.queryExecution().executedPlan().toString()
        # Below the join that repeats the rows, and behind a generator, so that no repeat makes it again.
        assert "regexp_replace" not in plan and plan.index("NestedLoopJoin") < plan.index("Generate explode(array(array_join(regexp_extract_all"), name
        assert table.count() % len(TEXTS) == 0
