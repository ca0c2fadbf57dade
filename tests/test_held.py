"""Words held by texts, in blocks and shards; contains mode by artifact, without tables of grams."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa

from doclens.operators import findings, held, rules

ODD = ["", "a", "ab", "abcdefgh", "abcdefghi", "0123456789abcdef", "0123456789abcdefg", "0123456789abcdefXY" * 3, "äöü", "\x00\x00", "\U0001f600x", "é"]


def test_words_of_every_length(spark, monkeypatch):
    monkeypatch.setattr(held, "BLOCK_BYTES", 300)
    monkeypatch.setattr(held, "SHARD_BYTES", 200)
    monkeypatch.setattr(held, "PLACES", 64)
    dice = random.Random(5)
    texts = [(k, "".join(dice.choice([*ODD, " ", "b", "c"]) for _ in range(dice.randrange(12)))) for k in range(60)] + [(60, None), (61, "x" * 500 + ODD[7]), (7, "abab")]
    table = spark.createDataFrame(texts, "artifact_id long, t string")
    signatures = [(w, f"{k}") for k, w in enumerate([*ODD, "ab", None])]
    found = findings.match_signatures(table, spark.createDataFrame(signatures, "sig string, label string")).collect()
    assert sorted(map(tuple, found)) == sorted((k, n) for k, t in texts for w, n in signatures if t and w and w in t)
    rows = [(f"R{k}", [a, b], [c]) for k, (a, b, c) in enumerate((dice.choice(ODD[1:]), dice.choice(ODD), dice.choice(ODD[1:])) for _ in range(40))]
    rows += [("R1", ["ab"], []), ("none", ["ab"], None), ("empty", ["ab"], [""])]
    found = rules.match_rule_table(table.withColumnRenamed("t", "value"), spark.createDataFrame(rows, "rule_id string, includes array<string>, excludes array<string>")).collect()
    want = [(k, r, t) for k, t in texts for r, i, x in rows if t and x is not None and any(w and w in t for w in i) and not any(w in t for w in x)]
    assert sorted(map(tuple, found)) == sorted(want)


def test_contains_by_artifact(spark, monkeypatch):
    dice = random.Random(6)
    words = ["", "a", "ab", "xaby", "note ab", "other", None]
    rows = [(dice.choice([1, 2, 3, 4, None]), k // 2, "R", "low", dice.choice(words), dice.choice(words)) for k in range(60)]
    table = spark.createDataFrame(rows, "artifact_id long, seq long, rule_id string, severity string, indication string, description string")
    first = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[4] is not None, r[4] or "")):
        first.setdefault((r[0], r[5]), r)
    want = [r for r in first.values() if r[5] is None or not any(e[0] == r[0] and e[1] < r[1] and any(x is not None and r[5] in x for x in e[4:]) for e in rows)]
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "doclens"

    def grams():
        return len(list(folder.glob("text-grams-*")))

    known = table.where("artifact_id is not null")
    before = grams()
    found = findings.dedup_findings(known, "contains").select(*table.columns).collect()
    assert grams() == before
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(r) for r in want if r[0] is not None)
    monkeypatch.setattr(findings, "PAIRED_ROWS", 12)
    found = findings.dedup_findings(table, "contains").select(*table.columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_words_across_the_places_looked_up_at_a_time(monkeypatch):
    monkeypatch.setattr(held, "PLACES", 64)
    schema = pa.schema([("artifact_id", pa.int64()), ("labels", pa.list_(pa.string()))])
    words = ["0123456789abcdef"[:n] for n in range(1, 17)] + ["0123456789abcdef and more"]
    texts = [("." * k + words[-1]) for k in range(40, 70)] + ["." * 30 + words[15] + "." * 300]
    shard = held._Rules(pa.table({"label": words, "includes": [[w] for w in words], "excludes": [[] for _ in words]}))
    table = pa.table({"artifact_id": np.arange(len(texts)), "t": texts})
    found = {(r["artifact_id"], x) for b in shard.matched(table, schema) for r in b.to_pylist() for x in r["labels"]}
    assert found == {(k, w) for k, t in enumerate(texts) for w in words if w in t}


def test_texts_and_rules_are_not_copied_by_a_shuffle(spark, monkeypatch):
    """Blocks meet shards without a shuffle of either, however many there are."""
    monkeypatch.setattr(held, "BLOCK_BYTES", 300)
    monkeypatch.setattr(held, "SHARD_BYTES", 200)
    texts = spark.createDataFrame([(k, f"text {k} " * 20) for k in range(50)], "artifact_id long, t string")
    words = spark.createDataFrame([(f"R{k}", [f"xt {k} t"], []) for k in range(50)], "label string, includes array<string>, excludes array<string>")
    found = held.held_labels(texts, words)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert sorted((r.artifact_id, x) for r in found.collect() for x in r.labels) == [(k, f"R{k}") for k in range(50)]
