"""The ledger against full runs, and the sketches' error against exact counts."""

import pytest
from pyspark.sql import functions as F

from doclens.operators import findings as exact
from doclens.operators import rollups, sketches
from doclens.sources.tables import new_path

FIELDS = "artifact_id long, rule_id string, severity string"


def plain(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def full(rows):
    return plain(exact.severity_rollup(rows).join(exact.verdict(rows), "artifact_id"))


def test_ledger_equals_a_full_run(spark):
    first = spark.createDataFrame([(1, "A", "low"), (1, "A", "low"), (2, "B", "high"), (3, "A", "info")], FIELDS)
    second = spark.createDataFrame([(4, "A", "medium"), (2, "A", "low")], FIELDS)
    ledger = rollups.Ledger(spark, new_path(spark, "ledger"))
    assert plain(ledger.rollup()) == [] and plain(ledger.prevalence()) == []
    ledger.add(first, "1")
    ledger.add(second, "2")
    ledger.add(second, "2")
    both = first.unionByName(second)
    assert plain(ledger.rollup()) == full(both)
    old = ledger.rollup().collect()
    # Rule B finds nothing now, so artifact 2's verdict falls; then A is raised, twice under one name.
    ledger.change_rule("B", both.limit(0), "B-2")
    after = both.where("rule_id <> 'B'")
    assert plain(ledger.rollup()) == full(after)
    step = spark.createDataFrame([(2, "B", "high", -1)], FIELDS + ", n long")
    assert plain(rollups.updated(spark.createDataFrame(old), step)) == full(after)
    raised = after.withColumn("severity", F.lit("high"))
    for _ in range(2):
        ledger.change_rule("A", raised, "A-2")
        assert plain(ledger.rollup()) == full(raised)
    assert plain(ledger.prevalence()) == [("A", 4, 5)]
    small = ledger.compacted(new_path(spark, "ledger"))
    assert plain(small.rollup()) == full(raised) and plain(small.current()) == plain(ledger.current())
    ledger.change_rule("A", raised, "A-3")
    assert ledger.rows().count() == ledger.rows(without="A-3").count()  # An equal version writes nothing.


def test_ledger_keeps_nulls(spark):
    rows = spark.createDataFrame([(None, "A", "low"), (1, None, "low"), (2, "A", None)], FIELDS)
    ledger = rollups.Ledger(spark, new_path(spark, "ledger"))
    ledger.add(rows, "1")
    assert plain(ledger.current()) == plain(rollups.signed_counts(rows))


def test_sketches_merge(spark):
    """60,000 artifacts over 20 days, each on two of them; three descriptions among very many."""
    rows = spark.range(120_000).select(
        (F.col("id") % 60_000).alias("artifact_id"), (F.col("id") % 19).alias("day"), F.concat(F.lit("R"), F.col("id") % 3).alias("rule_id"),
        F.when(F.col("id") % 10 < 3, F.concat(F.lit("often "), F.col("id") % 10)).otherwise(F.concat(F.lit("once "), "id")).alias("description"),
    )
    found = {r.rule_id: r for r in sketches.prevalence(sketches.prevalence_sketches(rows, "day")).collect()}
    true = {r.rule_id: r.n for r in rows.groupBy("rule_id").agg(F.countDistinct("artifact_id").alias("n")).collect()}
    assert true.keys() == found.keys()
    assert all(abs(found[k].n_artifacts - n) <= 3 * sketches.relative_error() * n for k, n in true.items())
    assert {k: r.n_findings for k, r in found.items()} == dict.fromkeys(true, 40_000)
    frequent = sketches.frequent_indicators(rows, sketches.indicator_sketches(rows, "day"), 0.05)
    assert plain(frequent) == [(f"often {k}", 12_000, 6_000) for k in range(3)]
    with pytest.raises(ValueError, match="share"):
        sketches.frequent_indicators(rows, sketches.indicator_sketches(rows, "day"), 0.0001)
    none = rows.limit(0)
    assert plain(sketches.prevalence(sketches.prevalence_sketches(none, "day"))) == []
    assert plain(sketches.frequent_indicators(none, sketches.indicator_sketches(none, "day"))) == []
