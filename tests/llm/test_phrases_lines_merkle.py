"""Collocations, line dedup and the Merkle manifest against brute force, with the edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from conftest import CLASHING, SCHEMA
from pyspark.sql import functions as F

from doclens.llm import lines, merkle
from doclens.llm.lines import LineRuns, fresh_runs, line_dedup
from doclens.llm.merkle import merkle_manifest
from doclens.llm.phrases import collocations


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_collocations(rows, min_count, top):
    f, n, found = Counter(), Counter(), []
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    frequent = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= min_count}
    for (lang, p), a in frequent.items():
        inside = ((q, c) for (other, q), c in frequent.items() if other == lang and len(q) > len(p))
        if any(100 * c >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in inside):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        seen[lang] += 1
        if seen[lang] <= top:
            out.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def texts_of(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "c", "D", "é", "É", "ab", "x\x0by", "New", "york"]
    return [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_collocations(spark):
    texts = texts_of(3) + ["new york city"] * 30 + [None, "", " \t ", "to be or not to be " * 40, "b b b b b b", "x " * 3000]
    rng = random.Random(4)
    rows = [(k, t, rng.choice(["en", "de", None]), "s", 0) for k, t in enumerate(texts)] + [(0, texts[0], None, "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("place", "word", "item", "phrase", "n", "doc", "f", *CLASHING):
        df = df.withColumn(name, F.lit("x"))
    for min_count, top in ((3, 1000), (8, 5)):
        wanted = brute_collocations([(r[2], r[1]) for r in rows], min_count, top)
        assert wanted
        for broadcast_groups in (1000, 0):
            found = collocations(df, min_count, top=top, broadcast_groups=broadcast_groups)
            assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
            assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert collocations(df.limit(0), 3).count() == 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_collocation_scores_pass_64_bits(spark):
    from doclens.llm.phrases import scored

    big = 3 * 10**15
    phrases = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)], "lang string, n_words int, phrase string, f long")
    totals = spark.createDataFrame([("en", 7 * 10**16)], "lang string, n long")
    assert [r.score for r in scored(phrases, totals).collect()] == [1000 * (big - 2) * 7 * 10**16 // (big * (big - 1))]


def key_of(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, held=None, counted=None, min_points=40, min_docs=5):
    """held: line -> id that keeps it by earlier batches; counted: line -> documents of earlier batches."""
    docs, keep = Counter(counted or {}), {}
    for doc_id, text in rows:
        for k in {key_of(x) for x in (text or "").split("\n")}:
            if len(k) >= min_points:
                docs[k] += 1
                if k not in keep or (doc_id is not None and (keep[k] is None or doc_id > keep[k])):
                    keep[k] = doc_id
    keep |= held or {}
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        stay = [x for x in all_lines if not (len(key_of(x)) >= min_points and docs[key_of(x)] >= min_docs and keep[key_of(x)] != doc_id)]
        out.append((doc_id, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str), docs, keep


def line_rows(seed):
    rng = random.Random(seed)
    common = ["Common line number %d that is long enough to count é" % k for k in range(6)] + ["short", "", "x" * 39, "x" * 40]
    rows = []
    for k in range(40):
        own = [rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str])(rng.choice(common)) + rng.choice(["", "\r", " \x0b"]) for _ in range(rng.randint(0, 6))]
        own += [f"own line {k} of this document, which no other document has {rng.random()}"]
        rng.shuffle(own)
        rows.append((k * 3 + 1, "\n".join(own)))
    return rows + [(500, None), (501, ""), (502, "\n\n"), (rows[0][0], rows[0][1]), (None, rows[5][1]), (503, common[0] + "\n" + common[0]), (504, "y " * 60_000)]


def test_line_dedup(spark, docs):
    rows = line_rows(1)
    runs = fresh_runs(spark, 4)
    found = line_dedup(docs(*rows, extra=["line_key", "pos", "lost", "stretch", "lines", *CLASHING]), runs, "one")
    wanted, counted, keep = brute_lines(rows)
    assert sorted(map(tuple, found.collect()), key=str) == wanted
    assert sum(r[2] for r in wanted) > 20
    # Three of four batches are merged into a run of the next level.
    assert sorted(e["level"] for e in runs.live()) == [0, 1]
    # The same batch again, as after a failure: neither counts nor keepers change.
    again = line_dedup(docs(*rows), LineRuns(spark, runs.path, 4), "one")
    assert sorted(map(tuple, again.collect()), key=str) == wanted
    # A later batch loses the lines that earlier documents keep.
    later = [(1000 + d if d is not None else None, t) for d, t in line_rows(2)]
    found = line_dedup(docs(*later), LineRuns(spark, runs.path, 4), "two")
    wanted, _, _ = brute_lines(later, keep, counted)
    assert sorted(map(tuple, found.collect()), key=str) == wanted
    assert [r.n_docs for r in LineRuns(spark, runs.path, 4).merged().where(F.col("line_key") == F.unhex(F.md5(F.lit("x" * 40)))).collect()] == [counted["x" * 40] + brute_lines(later)[1]["x" * 40]]
    runs.close()
    assert line_dedup(docs().limit(0), fresh_runs(spark, 4), "none").count() == 0


def test_runs_stay_few(spark):
    runs = fresh_runs(spark, 2)
    for k in range(10):
        keys = spark.createDataFrame([(bytes([j]), 1, k) for j in range(k, k + 3)], "line_key binary, n_docs long, keep_id long")
        runs.add(keys, f"b{k}")
        runs.add(keys, f"b{k}")
    assert [e["level"] for e in runs.live()] == [2, 0]
    found = {r.line_key[0]: (r.n_docs, r.keep_id) for r in runs.merged().collect()}
    assert found == {j: (len([k for k in range(10) if k <= j < k + 3]), max(0, j - 2)) for j in range(12)}
    assert line_keys_are_exact(spark)


def line_keys_are_exact(spark):
    df = spark.createDataFrame([(1, "  É" + "A" * 39 + " "), (2, "É" + "a" * 38)], "doc_id long, text string")
    return [bytes(r.line_key) for r in lines.line_keys(df).collect()] == [hashlib.md5(("É" + "a" * 39).encode()).digest()]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, more=0):
    doc_id, text, lang, source, n_chars = r
    return h("".join(map(field, (doc_id, source, lang, None if n_chars is None else n_chars + more, text))))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([h("".join(own[i : i + 2])) for i in range(0, len(own), 2)])
    return levels


def path_of(levels, i):
    for own in levels[:-1]:
        yield i % 2 == 1, own[i ^ 1] if i ^ 1 < len(own) else ""
        i //= 2


def brute_merkle(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[name] = levels_of([leaf_of(r) for r in groups[name]])
    over = levels_of([trees[n][-1][0] for n in names])
    out = []
    for g, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            path = [*path_of(trees[name], i), *path_of(over, g)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            end = leaf_of(r, int(tampered))
            for is_left, other in path:
                end = h(other + end if is_left else end + other)
            out.append((r[0], leaf_of(r), trees[name][-1][0], over[-1][0], h("".join(s for _, s in path)), end, end == over[-1][0]))
    return sorted(out, key=str)


def merkle_query(spark, df, monkeypatch):
    monkeypatch.setattr(merkle, "documents", lambda *_: df)
    return sorted(map(tuple, merkle.op13_merkle_manifest(spark, "").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_merkle_manifest(spark, monkeypatch):
    rng = random.Random(7)
    # Groups of 1, 2, 3, 64, 65 and several hundred leaves; STEP levels are 64 leaves.
    rows = [(k, rng.choice(["", "text é", None, "t" * 300]), lang, rng.choice(["s", None, "é"]), rng.choice([None, 0, -3, 10**12])) for lang, n in (("en", 300), ("de", 65), ("é", 64), ("z", 3), ("y", 2), (None, 1), ("", 1)) for k in rng.sample(range(5000), n)]
    rows += [rows[0], rows[0], (None, "a", "en", "s", 1), (None, None, None, None, None), (9999, "w" * 200_000, "en", "s", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "i", "digest", "left", "top", "kept_changed", *CLASHING):
        df = df.withColumn(name, F.lit("x"))
    wanted = brute_merkle(rows)
    assert merkle_query(spark, df.repartition(5), monkeypatch) == wanted
    assert 0 < sum(not r[-1] for r in wanted) < len(wanted) / 3
    one = [(5, "alone", "en", "s", 5)]
    assert merkle_query(spark, spark.createDataFrame(one, SCHEMA), monkeypatch) == brute_merkle(one)
    assert merkle_query(spark, df.limit(0), monkeypatch) == []


def test_proofs_show_any_change(spark):
    rows = [(k, f"text {k}", "en" if k % 3 else None, "s", k) for k in range(100)]
    found = merkle_manifest(spark.createDataFrame(rows, SCHEMA))
    tried = found.select("root", merkle.folded(F.col("leaf"), F.col("proof")).alias("own"), merkle.folded(F.sha2(F.lit("other"), 256), F.col("proof")).alias("forged")).collect()
    assert len(tried) == 100 and len({r.root for r in tried}) == 1
    assert all(r.own == r.root != r.forged for r in tried)
