"""A batch that runs twice, rates of any size, and chains of links in order."""

import math
import time

from pyspark.sql import functions as F

from doclens.llm.components import components
from doclens.llm.exact import DigestIndex, exact_dedup
from doclens.llm.mixing import poisson_count, poisson_mix
from doclens.llm.shared import new_path


def test_a_batch_again_keeps_what_it_kept(spark, docs):
    path = new_path(spark, "index")
    rows = docs((1, "a"), (2, " a"), (3, "b"), (4, "b"))
    first = sorted(map(tuple, exact_dedup(rows, DigestIndex(spark, path, 4), batch="monday").collect()))
    again = sorted(map(tuple, exact_dedup(rows, DigestIndex(spark, path, 4), batch="monday").collect()))
    assert first == again and sum(r[3] for r in first) == 2
    later = exact_dedup(docs((9, "a"), (8, "c")), DigestIndex(spark, path, 4), batch="tuesday").collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in later} == {9: (2, False), 8: (8, True)}
    assert DigestIndex(spark, path, 4).rows().count() == 3


def inverse(rate, u):
    log, total, n = -rate, math.exp(-rate), 0
    for k in range(1, math.ceil(rate + 10 * math.sqrt(rate) + 40) + 1):
        n += total < u
        log += math.log(rate / k)
        total += math.exp(log)
    return n + (total < u)


def test_rates_of_any_size(spark):
    cases = [(rate, u) for rate in (0.0, 1e-9, 0.3, 1.0, 7.5, 300.0, 2000.0, 1e5) for u in (1e-15, 0.02, 0.5, 0.97, 1 - 1e-12)]
    df = spark.createDataFrame(cases, "rate double, u double")
    df.select(poisson_count(F.col("rate"), F.col("u"))).collect()
    began = time.time()
    found = df.select(poisson_count(F.col("rate"), F.col("u")).alias("n")).collect()
    assert time.time() - began < 5
    for (rate, u), r in zip(cases, found, strict=True):
        assert abs(r.n - (inverse(rate, u) if rate else 0)) <= 1, (rate, u)
    assert abs(next(r.n for (rate, u), r in zip(cases, found, strict=True) if (rate, u) == (1e5, 0.5)) - 1e5) < 10


def test_sources_by_broadcast_or_by_join(spark, docs):
    rows = docs(*[(k, "w " * (k % 7 + 1), [None, "a", "b", "c"][k % 4]) for k in range(200)], extra=["mix_salt", "salt"])
    one, other = (sorted(map(tuple, poisson_mix(rows, broadcast_sources=n).select("doc_id", "source", "mix_copy", "mix_key").collect()), key=str) for n in (100, 0))
    assert one == other and one


def test_chains_take_few_rounds(spark, monkeypatch):
    from doclens.llm import components as module

    rounds = []
    write = module.written
    monkeypatch.setattr(module, "written", lambda df, label: rounds.append(label) or write(df, label))
    n = 4096
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components(chain)
    assert found.agg(F.count("*"), F.min("comp"), F.max("comp")).first() == (n, 0, 0)
    assert rounds.count("edges") <= 3 and rounds.count("labels") <= 16
    # Two chains, and a comb whose teeth hook to each other.
    comb = [(2 * k, 2 * k + 1) for k in range(50)] + [(2 * k + 1, (2 * k + 4) % 100) for k in range(0, 50, 2)]
    links = spark.createDataFrame([(1000 + k, 1001 + k) for k in range(30)] + comb, "a long, b long")
    parent = {x: x for pair in comb + [(1000 + k, 1001 + k) for k in range(30)] for x in pair}
    for _ in range(100):
        for a, b in comb + [(1000 + k, 1001 + k) for k in range(30)]:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {r.node: r.comp for r in components(links).collect()} == parent
