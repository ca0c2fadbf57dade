"""Near dedup, packing and substring dedup against brute force, with the edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import CLASHING
from pyspark.sql import functions as F

from doclens.llm import minhash, packing, substring


def family(rng, n, words, change):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, change)):
            own[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        yield " ".join(own)


def weights(text):
    words = (text or "").split()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in set(a) & set(b))


def classes(rows):
    sets = [weights(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[top(i)].append(doc)
    return sorted(sorted(g) for g in groups.values())


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 2**63, 200).astype(np.uint64))
    b = np.sort(np.concatenate([a[:170], rng.integers(0, 2**63, 40).astype(np.uint64)]))
    wa, wb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
    docs = np.repeat([0, 1], [len(a), len(b)])
    sig = minhash.signatures(docs, np.concatenate([a, b]), np.concatenate([wa, wb]).astype(float), 2, 4000)
    exact = similarity(Counter(dict(zip(a.tolist(), wa.tolist()))), Counter(dict(zip(b.tolist(), wb.tolist()))))
    assert minhash.probability_jaccard(a, wa, b, wb) == pytest.approx(exact)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


@pytest.mark.parametrize("limits", [{}, {"BLOCK_BYTES": 2000}, {"SMALL": 1, "PIVOT_ROUNDS": 0}, {"BLOCK_ROWS": 3, "SMALL": 1, "PIVOT_ROUNDS": 0}])
def test_near_dedup(docs, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(3)
    texts = [t for change in (1, 3, 9) for t in family(rng, 8, 60, change)]
    texts += ["a b c", "a b c", "a b d", "solo", "x y z " * 50, "x y z " * 60, "long " * 3000]
    rows = list(enumerate(texts))
    found = minhash.near_dedup(docs(*rows, extra=CLASHING)).collect()
    groups = defaultdict(list)
    for r in found:
        groups[r.class_id].append(r.doc_id)
    assert sorted(sorted(g) for g in groups.values()) == classes(rows)
    assert sorted(r.doc_id for r in found if r.stays) == sorted(groups)
    assert all(min(g) == c and all(r.class_size == len(g) for r in found if r.class_id == c) for c, g in groups.items())


def test_near_dedup_edges(docs):
    found = minhash.near_dedup(docs((1, None), (2, ""), (3, " "), (4, "a b"), (4, "a b"), (None, "q r"))).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in found) == [(0, 0, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 2), (4, 4, 2)]
    assert minhash.near_dedup(docs().limit(0)).count() == 0


def test_near_dedup_without_ids(docs):
    rng = random.Random(16)
    texts = list(family(rng, 6, 60, 1)) * 2
    rows = [(None, t) for t in texts] + [(k, f"other {k} words here and there") for k in range(5)] + [(None, "x y z"), (None, "p q"), (7, "p  q")]
    found = minhash.near_dedup(docs(*rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in found) == Counter(
        [(None, None, 12)] * 12 + [(k, k, 1) for k in range(5)] + [(None, None, 1), (None, 7, 2), (7, 7, 2)]
    )
    assert sum(r.stays for r in found) == 8


def naive_fit(items, capacity):
    bins, placed = [], []
    for size, source, cluster in items:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and not (b["s"] & source or b["c"] & cluster)]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "s": 0, "c": 0})
        placed.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= size
        bins[k]["s"] |= source
        bins[k]["c"] |= cluster
    return placed


def test_best_fit_is_the_tightest_compatible():
    rng = random.Random(4)
    for _ in range(50):
        items = [(rng.randint(0, 30), rng.choice([0, 1, 2, 4]), 1 << rng.randint(0, 9)) for _ in range(rng.randint(0, 60))]
        items.sort(key=lambda x: -x[0])
        assert packing.best_fit(items, 30) == naive_fit(items, 30)


def test_pack(docs):
    rng = random.Random(5)
    rows = [(k, " ".join(f"t{k % 40}_{i}" for i in range(rng.randint(0, 90))), f"s{rng.randint(0, 5)}") for k in range(300)]
    rows += [(900, None, "a"), (901, "", None), (902, "w " * 333, None), (903, "w", "s1"), (903, "w", "s1"), (None, "n n", "s2")]
    found = packing.pack(docs(*rows, extra=CLASHING), capacity=64, shard_rows=100).toPandas()
    sizes = Counter((k, len((t or "").split())) for k, t, _ in rows)
    pieces = found.assign(doc_id=found.doc_id.fillna(-1)).groupby(["doc_id"]).n_words.sum()
    for (k, n), times in sizes.items():
        assert pieces[-1 if k is None else k] == n * times
    source, text = {k: s for k, _, s in rows}, {k: t for k, t, _ in rows}
    for _, own in found.groupby(["shard", "bin"]):
        assert own.n_words.sum() <= 64
        ids = [None if pd.isna(d) else int(d) for d in own.doc_id]
        named = [source[d] for d in ids if source[d] is not None]
        assert len(named) == len(set(named))
        worded = [d for d in ids if text[d]]
        assert len({text[d] for d in worded}) == len(worded)
        spans = sorted(zip(own.bin_offset, own.n_words))
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert packing.pack(docs().limit(0)).count() == 0


def without_repeats(rows):
    windows = defaultdict(set)
    split = [(k, (t or "").split()) for k, t in rows]
    for k, words in split:
        if k is not None:
            for i in range(len(words) - 12):
                windows[tuple(words[i : i + 13])].add(k)
    for k, words in split:
        gone = set()
        if k is not None:
            for i in range(len(words) - 12):
                if min(windows[tuple(words[i : i + 13])]) < k:
                    gone |= set(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        yield k, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("chunk, memo, part", [(500_000, 10, 1 << 25), (60, 200_000, 1 << 25), (60, 3, 500)])
def test_repeated_passages(docs, monkeypatch, chunk, memo, part):
    monkeypatch.setattr("doclens.llm.minhash.CHUNK_WORDS", chunk)
    monkeypatch.setattr(substring, "MEMO_PATHS", memo)
    monkeypatch.setattr(substring, "PART_CHARS", part)
    rng = random.Random(6)
    passages = [[f"p{j}_{i}" for i in range(rng.randint(10, 40))] for j in range(5)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 20))]
            p = rng.choice(passages)
            cut = rng.randint(0, 5)
            words += p[cut : len(p) - rng.randint(0, 5)]
        rows.append((k * 3 % 61, " ".join(words)))
    rows += [(100, "z " * 200), (101, "z " * 15), (102, "a b " * 40), (103, None), (104, ""), (None, " ".join(passages[0]))]
    found = substring.remove_repeats(docs(*rows, extra=CLASHING)).collect()
    key = str
    assert sorted([tuple(r) for r in found], key=key) == sorted(without_repeats(rows), key=key)
    assert substring.remove_repeats(docs().limit(0)).count() == 0


def test_spans_have_sources(docs):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(["a"] * 3 + words)), (2, " ".join(["b"] * 5 + words + ["c"])), (2, "other")]
    spans = substring.repeated_spans(docs(*rows)).collect()
    assert [(s.doc_id, s.first_word, s.n_words, s.source_id, s.source_first_word) for s in spans] == [(2, 5, 60, 1, 3)]
    assert spans[0].digest == substring.words_digest([w.encode() for w in words])


def test_spans_decide_what_is_removed(docs, monkeypatch):
    """What is not verified at the source stays: each row of an id is judged by its own words."""
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:30])), (2, " ".join(words[5:])), (2, "x " + " ".join(words[3:20])), (2, "other " * 50)]
    found = sorted((r.n_words, r.n_removed) for r in substring.remove_repeats(docs(*rows)).collect())
    assert found == [(18, 17), (30, 30), (35, 35), (40, 0), (50, 0)]
    monkeypatch.setattr(substring, "compacted", lambda runs: compact(runs).withColumn("source_first_word", F.col("source_first_word") + 1))
    assert {r.n_removed for r in substring.remove_repeats(docs(*rows[:2])).collect()} == {0}


compact = substring.compacted


def test_bins_do_not_depend_on_the_order_of_rows(docs):
    rng = random.Random(15)
    rows = [(rng.choice([None, 1, 2, 3]), " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 6, 7]))), rng.choice(["s", "t", "u", None])) for _ in range(200)]
    packed = []
    for _ in range(3):
        rng.shuffle(rows)
        packed.append(Counter(tuple(r) for r in packing.pack(docs(*rows), capacity=20, shard_rows=50).collect()))
    assert packed[0] == packed[1] == packed[2]


def test_hot_ids_spread_over_shards(docs):
    rows = [(None, f"w{k} x y", "s") for k in range(400)]
    shards = Counter(r.shard for r in packing.pack(docs(*rows), capacity=20, shard_rows=50).collect())
    assert len(shards) == 8 and max(shards.values()) < 100


def test_given_clusters(spark, docs):
    df = docs(*[(k, f"w{k}", f"s{k}") for k in range(20)])
    packed = packing.pack(df, capacity=20, cluster_col="n_chars").collect()
    assert len({r.bin for r in packed}) == 20
