"""Quality rules, exact dedup and mixing against brute force, with the edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from conftest import CLASHING

from doclens.llm import mixing
from doclens.llm.exact import DigestIndex, exact_dedup, fresh_index
from doclens.llm.mixing import poisson_mix
from doclens.llm.quality import quality_rules
from doclens.llm.shared import new_path

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = [w for w in BLANK.split(text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if BLANK.sub("", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "a b c d e f g h " * 3, "x\n\nx\ny\nx ", "#$ | é\x0bü\x85 \x1c#", "w " * 5000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "one"), (None, "two words")]
    found = quality_rules(docs(*rows, extra=CLASHING)).collect()
    assert len(found) == len(rows)
    for r in found:
        n = measures(texts[r.doc_id] if r.doc_id is not None else "two words")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, r
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules(docs().limit(0)).count() == 0


def test_suspect_hosts_tighten_the_rules(docs):
    good = " ".join(f"word{k}" for k in range(30))
    odd = " ".join("####" for _ in range(1)) + " " + " ".join(f"#{k}#" for k in range(30))
    rows = [(k, "short", "bad") for k in range(50)] + [(50, good, "bad"), (51, odd, "bad")]
    rows += [(100 + k, good + str(k), f"h{k % 5}") for k in range(100)] + [(300, odd, "h1"), (301, good, None)]
    found = {r.doc_id: r for r in quality_rules(docs(*rows)).collect()}
    assert found[50].kept and found[50].host_suspect and not found[50].rule_failed
    assert not found[51].kept and found[51].rule_failed and not found[51].base_failed
    assert found[300].kept and found[300].rule_failed and found[301].kept


def test_exact_dedup(spark, docs):
    rows = [(5, "a b"), (3, "a  b "), (9, "ab"), (4, None), (2, ""), (1, "x"), (1, "x"), (None, "q"), (7, "q"), (8, "y" * 100_000)]
    found = exact_dedup(docs(*rows, extra=CLASHING), fresh_index(spark, 4)).collect()
    keep = defaultdict(set)
    for r in found:
        keep[r.keep_id].add((r.doc_id, r.group_size, r.kept))
    assert keep[3] == {(5, 3, False), (3, 3, True), (9, 3, False)}
    assert keep[2] == {(4, 2, False), (2, 2, True)}
    assert keep[1] == {(1, 2, True), (1, 2, False)} and sum(r.kept for r in found if r.keep_id == 1) == 1 and keep[7] == {(None, 2, False), (7, 2, True)}
    assert {r.text_sha256 for r in found if r.doc_id == 5} == {hashlib.sha256(b"ab").hexdigest()}
    assert exact_dedup(docs().limit(0), fresh_index(spark, 4)).count() == 0


def test_index_lasts(spark, docs):
    path = new_path(spark, "index")
    exact_dedup(docs((1, "a"), (2, "b")), DigestIndex(spark, path, 4)).count()
    again = DigestIndex(spark, path, 4)
    found = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(docs((7, " a "), (8, "c")), again).collect()}
    assert found == {7: (1, False), 8: (8, True)}
    assert sorted(r.keep_id for r in DigestIndex(spark, path, 4).rows().collect()) == [1, 2, 8]


def unit(*parts):
    return (int(hashlib.md5(":".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def inverse(rate, u):
    n, p = 0, math.exp(-rate)
    total = p
    while total < u:
        n += 1
        p *= rate / n
        total += p
    return n


def test_poisson_mix(docs):
    rows = [(k, "w " * (1 + k % 7), f"s{k % 3}") for k in range(200)] + [(200, "w", None), (201, None, "s1"), (202, "", "s2"), (None, "w w", "s0"), (5, "w", "s0")]
    tokens = defaultdict(int)
    for _, text, source in rows:
        tokens[source] += len((text or "").split())
    total, wanted = sum(tokens.values()), {s: t**0.5 for s, t in tokens.items()}
    rates = {s: wanted[s] / sum(wanted.values()) * total / tokens[s] for s in tokens}
    expected = Counter()
    for doc, text, source in rows:
        for copy in range(inverse(rates[source], unit("mix-1", doc))):
            expected[doc, text, source, copy] += 1
    df = docs(*rows, extra=CLASHING)
    found = poisson_mix(df).collect()
    assert Counter((r.doc_id, r.text, r.source, r.mix_copy) for r in found) == expected
    assert [r.mix_key for r in found] == sorted(r.mix_key for r in found)


def test_mix_weights_and_empty(docs):
    rows = [(k, "w w", "a" if k % 2 else "b") for k in range(400)]
    found = Counter(r.source for r in poisson_mix(docs(*rows), {"a": 3.0, "b": 1.0}).collect())
    assert 250 < found["a"] < 350 and 70 < found["b"] < 130
    assert poisson_mix(docs(*rows), {"a": 1.0}).where("source = 'b'").count() == 0
    assert poisson_mix(docs().limit(0)).count() == 0
    assert mixing.poisson_mix(docs((1, None), (2, ""))).count() == 0


def test_host_verdicts_act_on_the_given_hosts(docs):
    good = " ".join(f"word{k}" for k in range(30))
    odd = " ".join(f"#{k}#" for k in range(30))
    rows = [(k, f"{odd if k % 100 < 20 + 60 * (k % 10 == 0) else good} {k}", f"h{k % 10}") for k in range(1000)]
    found = quality_rules(docs(*rows), keep_rows=True).collect()
    assert {r.input_row.source for r in found if r.host_suspect} == {"h0"}
    assert all(r.kept == (not (r.rule_failed and r.host_suspect)) and r.input_row.doc_id == r.doc_id for r in found)
    assert sum(not r.kept for r in found) == 80


def test_compacted_index(spark, docs):
    index = fresh_index(spark, 4)
    for k in range(3):
        exact_dedup(docs((k, f"text {k}"), (9, "same")), index).count()
    other = index.compacted(new_path(spark, "index"))
    assert sorted(r.keep_id for r in other.rows().collect()) == [0, 1, 2, 9]
    index.close()
    other.close()
    assert not [t for t in spark.catalog.listTables() if t.name in (index.table, other.table)]


def test_mixing_long_texts(docs):
    assert {r.mix_rate for r in poisson_mix(docs((1, "w " * 100_000), (2, "w")), {"s": 3.0}).collect()} <= {1.0}
