"""The pipeline's stages against brute force."""

import random
from collections import Counter

import corpus_pipeline
from conftest import CLASHING, SCHEMA
from test_near_packing_substring import classes, family
from test_quality_exact_mixing import inverse, unit


def test_stages(spark, docs, tmp_path):
    rng = random.Random(11)
    texts = [*family(rng, 6, 50, 2), *family(rng, 6, 50, 0), "too short", "", None]
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(texts)]
    df = docs(*rows)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(12))
    exact = stages["exact dedup"](spark, kept, "")
    seen, first = set(), []
    for k, t, _ in rows[:12]:
        if t not in seen:
            seen.add(t)
            first.append(k)
    assert exact.columns == df.columns and sorted(r.doc_id for r in exact.collect()) == first
    near = stages["near dedup"](spark, exact, "")
    wanted = sorted(min(g) for g in classes([(k, texts[k]) for k in first]))
    assert near.columns == df.columns and sorted(r.doc_id for r in near.collect()) == wanted
    mixed = stages["mixing"](spark, near, "")
    assert mixed.columns == df.columns and {r.doc_id for r in mixed.collect()} <= set(wanted)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # The words of every document that is left, times its Poisson count.
    tokens = Counter()
    for k in wanted:
        tokens[f"s{k % 3}"] += len(texts[k].split())
    rooted = {s: t**0.5 for s, t in tokens.items()}
    rates = {s: rooted[s] / sum(rooted.values()) * sum(tokens.values()) / tokens[s] for s in tokens}
    copies = Counter({k: inverse(rates[f"s{k % 3}"], unit("mix-1", k)) for k in wanted})
    assert Counter(r.doc_id for r in mixed.collect()) == +copies
    words = Counter()
    for r in packed:
        words[r.doc_id] += r.n_words
    assert words == +Counter({k: copies[k] * len(texts[k].split()) for k in wanted})
    for own in {(r.shard, r.bin) for r in packed}:
        inside = [r for r in packed if (r.shard, r.bin) == own]
        assert len({r.doc_id % 3 for r in inside}) == len(inside)


def test_repeated_ids_and_empty_input(spark, docs, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    df = docs((1, "a"), (1, "a"), (1, "b"), (2, "b "), (None, "c"), (None, "c"))
    out = stages["exact dedup"](spark, df, "")
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "c"), (1, "a"), (2, "b ")]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_verdicts_stay_with_their_rows(spark, docs):
    """Rows of one id, or of none, each get their own verdict in every stage."""
    rng = random.Random(17)
    good = list(family(rng, 4, 60, 1)) + [" ".join(f"w{k}_{i}" for i in range(40)) for k in range(4)]
    rows = [(1, t) for t in good] + [(1, "short"), (1, good[5])] + [(None, t) for t in good[4:6]] + [(None, "short"), (2, good[6] + " ")]
    stages = dict(corpus_pipeline.STAGES)
    df = docs(*rows, extra=["kept", "row_no", "input_row", "pipeline_row_no"])
    quality = stages["quality rules"](spark, df, "")
    assert sorted(r.text for r in quality.collect()) == sorted(t for _, t in rows if t != "short") and quality.columns == df.columns
    exact = stages["exact dedup"](spark, df, "")
    assert sorted(r.text for r in exact.collect()) == sorted([*good[:6], good[6] + " ", good[7], "short"])
    near = stages["near dedup"](spark, df, "")
    texts = [r.text for r in near.collect()]
    assert len(texts) == 6 and len(set(texts) & set(good[:4])) == 1 and {good[4], good[5], good[7], "short"} < set(texts)


def test_run_with_extra_columns(spark, docs, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    docs(*[(k, f"{text} {k}", "s") for k in range(20)], extra=CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "piece", "first_word", "n_words", "shard", "bin", "bin_offset"]
