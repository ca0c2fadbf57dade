"""Token counts, personal data, toxicity and license scans against their libraries and brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import CLASHING
from tokenizers import Tokenizer

from doclens.llm import licenses, pii, tokens, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(docs):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    parts = ["a", "the", "'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "123", "é", "漢", "　", "!", "...", "<|endoftext|>", "'v", "'l", "don't", "aaa", "\r\n", "٣", "½", "\x1c", "\x85", "🎉", "zz"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", " ", "a" * 5000, "ab" * 3000, "\n" * 700, "x\n y" * 900]
    counter = tokens.Counter(*tokens.tokenizer_parts(PATH))
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == wanted
    found = tokens.token_counts(docs(*enumerate(texts[:50]), (50, None), (7, texts[7]), (None, "x"), extra=CLASHING), PATH, limit=3).collect()
    for r in found:
        text = "x" if r.doc_id is None else "" if r.doc_id == 50 else texts[r.doc_id]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 3)
    assert tokens.token_counts(docs().limit(0), PATH).count() == 0


def test_long_texts_are_cut_where_pieces_start(monkeypatch):
    monkeypatch.setattr(tokens, "STREAM", 50)
    library = Tokenizer.from_file(PATH)
    counter = tokens.Counter(*tokens.tokenizer_parts(PATH))
    rng = random.Random(6)
    texts = ["".join(rng.choice(["ab ", "\n", "\n\n ", "c'll", "9", " ", "?!"]) for _ in range(200)) for _ in range(50)]
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


KINDS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def naive_spans(text):
    out = []
    for kind, pattern in enumerate(KINDS):
        own = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            own.append(m.span())
        out.append(own)
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    parts = ["a", "b.c", "@", "@@", ".", "-", "+", "1", "23", "255", "256", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "+1 (234) 555-0100", " ", "\n", "é", "x@y.z", "(", "00001.2.3.4"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == naive_spans(text), text
    assert pii.base_spans("a" * 200_000 + "@" * 1000 + "1" * 100_000)[0] == []


def test_field_carries_labels_to_like_tokens(docs):
    call = "Call +1 (234) 555-0100 now."
    texts = [f"{call} Again 234-555-0100 or 555-0100 please. {k}" for k in range(30)] + ["room 555-0100 only", "none", None, ""]
    field = pii.fit([t for t in texts if t] * 3)
    found = {r.doc_id: r for r in pii.find_pii(docs(*enumerate(texts), (None, call), extra=CLASHING), field).collect()}
    text = texts[0]
    start = text.index("or 555-0100") + 3
    assert f"phone:{start}:{start + 8}" in found[0].spans.split(",") and found[0].n_phone == 1
    assert found[30].spans == "" and found[31].spans == "" and found[32].n_phone == 0 and found[33].spans == ""
    assert pii.find_pii(docs().limit(0), field).count() == 0


def test_beliefs_equal_enumeration_on_a_tree():
    rng = np.random.default_rng(1)
    unary, edges, tables = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]]), rng.normal(size=(3, 3, 3))
    total = np.zeros((4, 3))
    for labels in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(unary[i, k] for i, k in enumerate(labels)) + sum(t[labels[i], labels[j]] for (i, j), t in zip(edges, tables)))
        for i, k in enumerate(labels):
            total[i, k] += p
    assert np.allclose(pii.beliefs(unary, edges, tables), total / total.sum(axis=1, keepdims=True), atol=0.02)


def dense_cosines(index, ids, counts, own_ids, own_counts):
    """Cosines of one vector with all examples, in the order of ids, term by term."""

    def dense(i, c):
        v = np.zeros(len(index.weight))
        v[i] = (1 + np.log(c)) * index.weight[i]
        return v / (np.sqrt((v * v).sum()) or 1)

    own = dense(own_ids, own_counts)
    return np.array([dense(i, c) @ own for i, c in zip(ids, counts)])


@pytest.mark.parametrize("n, n_terms", [(500, 40), (1000, 5000), (3, 10), (700, 3)])
def test_block_max_search_is_exact(n, n_terms):
    rng = np.random.default_rng(2)
    ids = [np.sort(rng.choice(n_terms, rng.integers(0, min(n_terms, 30)), replace=False)) for _ in range(n)]
    counts = [rng.integers(1, 4, len(i)).astype(float) for i in ids]
    weight = rng.random(n_terms) * (rng.random(n_terms) < 0.9)
    toxic, names = rng.random(n) < 0.3, rng.permutation(n)
    index = toxicity.BlockMaxIndex(names, toxic, ids, counts, weight)
    at, source = {int(d): k for k, d in enumerate(index.doc_ids)}, {int(d): k for k, d in enumerate(names)}
    for q in range(min(n, 60)):
        for leave in (-1, at[int(names[q])]):
            exact = dense_cosines(index, ids, counts, ids[q], counts[q])
            if leave >= 0:
                exact[q] = 0
            exact = np.round(exact, toxicity.DECIMALS)
            floor = max(np.sort(exact)[-toxicity.NEIGHBOURS :][0], 10.0**-toxicity.DECIMALS)
            features, places, near = index.features(ids[q], counts[q], leave)
            found = {int(index.doc_ids[p]): c for p, c in zip(places, near)}
            sure = {int(names[k]) for k in np.flatnonzero(exact > floor + 2e-6)}
            assert sure <= set(found) and all(abs(exact[source[d]] - c) < 3e-6 and c >= floor - 3e-6 for d, c in found.items())
            assert len(found) >= min(toxicity.NEIGHBOURS, (exact > 2e-6).sum())
            votes = [exact[source[d]] ** 2 for d in found]
            share = sum(v for d, v in zip(found, votes) if toxic[source[d]]) / sum(votes) if votes else 0.0
            assert abs(features[1] - share) < 1e-3


def test_tied_neighbours_all_vote_whatever_their_ids():
    ids = [np.array([0, k % 2 + 1]) for k in range(200)]
    counts = [np.ones(2)] * 200
    toxic = np.arange(200) % 4 == 0
    scores = set()
    for names in (np.arange(200), np.arange(200)[::-1], np.random.default_rng(3).permutation(200)):
        index = toxicity.BlockMaxIndex(names, toxic, ids, counts, np.array([1.0, 2.0, 2.0]))
        features, places, _ = index.features(np.array([0, 1]), np.ones(2))
        scores.add((round(features[1], 9), len(places)))
    assert scores == {(0.5, 100)}


def test_scores_equal_brute_force_over_all_terms(spark, docs):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["Alpha", "beta", "gammas", "gammata", "omega", "x", "bad", "worse"]) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    texts += ["word " * 30_000 + "bad", None, ""]
    labels = [(k, int("bad" in (texts[k] or ""))) for k in range(150)] + [(150, 1)]
    found = {r.doc_id: r for r in toxicity.toxicity(docs(*enumerate(texts)), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    terms = [Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for t in texts]
    train = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 != 1]
    toxic = {k for k, label in labels if label}
    every = sorted({t for k in train for t in terms[k]})
    n1, n0 = sum(k in toxic for k in train), sum(k not in toxic for k in train)
    weight = {}
    for t in every:
        a, b = sum(t in terms[k] for k in train if k in toxic), sum(t in terms[k] for k in train if k not in toxic)
        spread = (a + b) * (n1 + n0 - a - b) * n1 * n0
        phi = abs(a * n0 - b * n1) / math.sqrt(spread) if spread else 0.0
        weight[t] = phi * (math.log((1 + len(texts)) / (1 + sum(t in x for x in terms))) + 1e-3)

    def vector(k):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in terms[k].items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    vectors = {k: vector(k) for k in range(len(texts))}
    by_features = defaultdict(set)
    for k in range(len(texts)):
        near = {j: round(sum(x * vectors[j].get(t, 0) for t, x in vectors[k].items()), 6) for j in train}
        near = {j: c for j, c in near.items() if c > 0}
        floor = sorted(near.values())[-15] if len(near) >= 15 else 0
        near = {j: c for j, c in near.items() if c >= floor}
        share = sum(c * c for j, c in near.items() if j in toxic) / sum(c * c for c in near.values()) if near else 0.0
        top = max([c for j, c in near.items() if j in toxic], default=0.0)
        by_features[round(share, 4), round(top, 4)].add(round(found[k].score, 2))
        if near:
            assert abs(found[k].evidence[0].cosine - max(near.values())) < 2e-6
    assert all(max(s) - min(s) < 0.03 for s in by_features.values())


def test_toxicity_on_held_out_rows(spark, docs):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randint(0, 30)) for _ in range(30)]
        if toxic:
            words += rng.sample(["badone", "badtwo", "badthree"], 2)
        rows.append((k, " ".join(words), "s"))
        labels.append((k, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "badone badtwo")]
    table = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs(*rows, extra=CLASHING), table).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    assert all(not r.predicted for r in found if r.doc_id in (1000, 1001)) and all(r.predicted for r in found if r.doc_id is None)
    assert toxicity.toxicity(docs((1, "a")), table.limit(0)).count() == 1
    assert toxicity.toxicity(docs().limit(0), table).count() == 0


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_license_matches_equal_brute_force(docs, threshold):
    rng = random.Random(9)
    words = sorted({w for _, t in licenses.NOTICES for w in licenses.tokens(t)}) + ["mit", "le", "und", "x"]
    texts = []
    for _ in range(60):
        notice = rng.choice(licenses.NOTICES)[1].split()
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 3))]
        lines.insert(0, " ".join(w for w in notice if rng.random() > 0.1))
        texts.append("\n".join(lines))
    rows = [*enumerate(texts), (500, None), (501, "")]
    _, matches = licenses.license_scan(docs(*rows, extra=CLASHING), threshold=threshold)
    expected = set()
    for k, text in rows:
        for line in (text or "").split("\n"):
            own = licenses.tokens(line)
            for s in range(0, max(1, len(own) - licenses.STEP), licenses.STEP) if len(own) > licenses.BLOCK else (0,):
                part = set(own[s : s + licenses.BLOCK])
                for n, _, notice in licenses.notice_table(licenses.NOTICES):
                    if len(part & set(notice)) >= threshold * len(notice) - 1e-9:
                        expected.add((k, n, round(len(part & set(notice)) / len(notice), 6)))
    assert {(r.doc_id, r.notice, round(r.containment, 6)) for r in matches.collect()} == expected


def test_license_phrases(spark, tmp_path, docs):
    rows = [(1, "The MIT License. x Apache-License general public LICENSE"), (2, "mit lizenz"), (3, None), (4, ""), (None, "mit license")]
    docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in licenses.op9_license_scan(spark, str(tmp_path)).collect()}
    one = found[1]
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels, one.score) == (9, 3, 1, 6, "apache,gpl,mit", 0.4)
    assert (found[2].n_base, found[2].first_word, found[2].base_labels, found[3].n_words) == (0, None, "", 0)
    assert found[None].n_base == 1


def test_license_notices_over_several_lines(spark, tmp_path, docs):
    rng = random.Random(10)
    filler = [f"w{k}" for k in range(50)]
    rows, labels = [], []
    for label, text in licenses.NOTICES:
        for width in (1, 3, 5, 8, 13):
            words = text.split()
            wrapped = "\n * ".join(" ".join(words[s : s + width]) for s in range(0, len(words), width))
            rows.append((len(rows), " ".join(rng.choices(filler, k=rng.randint(0, 200))) + "\n * " + wrapped + "\n" + " ".join(rng.choices(filler, k=rng.randint(0, 9)))))
            labels.append(label)
    docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.labels.split(",") for r in licenses.op9_license_scan(spark, str(tmp_path)).collect()}
    assert [k for k, label in enumerate(labels) if label not in found[k]] == []


@pytest.mark.parametrize("n_words", [33, 48, 100, 700])
def test_long_license_notices(docs, n_words):
    notice = [f"term{k}" for k in range(n_words)]
    rows = [(k, "\n".join(["x"] * k + [" ".join(notice[s : s + 9]) for s in range(0, n_words, 9)])) for k in range(0, 150, 7)]
    rows += [(k + 1000, "x " * k + " ".join(notice)) for k in range(0, 150, 7)] + [(2000, " ".join(notice[: n_words // 2]))]
    _, matches = licenses.license_scan(docs(*rows), [("own", " ".join(notice))])
    assert {r.doc_id for r in matches.where("containment = 1").collect()} == {k for k, _ in rows} - {2000}
    assert matches.where("doc_id = 2000").count() == 0


def test_field_joins_like_mentions():
    texts = [
        "Call +1 (234) 555-0100 now. Again 234-555-0100 or 555-0100 please.",
        "London +44 20 7946 0958, at home 020 7946 0958 and (0)20 7946 0958. It has 3 rooms",
        "Mail to jane.doe@example.com or jane.doe@intranet, not to john@intranet",
    ]
    field = pii.fit([f"{t} {k}" for k in range(30) for t in texts])

    def added(text):
        return [(pii.KINDS[k], text[s:e]) for k, own in enumerate(pii.added_spans(text, pii.base_spans(text), field)) for s, e in own]

    assert added(texts[0]) == [("phone", "234-555-0100"), ("phone", "555-0100")]
    assert added(texts[1]) == [("phone", "020 7946 0958"), ("phone", "(0)20 7946 0958")]
    assert added("Call +44 20 7946 0958, or (020 7946 0958).") == [("phone", "020 7946 0958")]
    assert added(texts[2]) == [("email", "jane.doe@intranet")]
    assert added("Call +1 (234) 555-0100 or room 0100 or 12 555-0199") == []
    assert added("Card 4111111111111111 and 1111111") == []


def test_skip_edges_decide_what_is_added(monkeypatch):
    rng = random.Random(13)
    field = pii.fit([f"Phone +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} and room {rng.randint(1, 999)} until {k}.5.2020" for k in range(200)])
    added = wanted = right = without = 0
    edges = pii.edges_of
    for k in range(100):
        a, b, c = rng.randint(200, 999), rng.randint(1000, 9999), rng.randint(1000, 9999)
        text = f"Phone +1 ({a}) 555-{b} or {a}-555-{b}, also {a} 555 {b}. Not {a}-556-{c} or {c}{b} or 1.2.2021"
        planted = {(text.index(x), text.index(x) + len(x)) for x in (f"{a}-555-{b}", f"{a} 555 {b}")}
        base = pii.base_spans(text)
        found = {x for own in pii.added_spans(text, base, field) for x in own}
        added, wanted, right = added + len(found), wanted + len(planted), right + len(found & planted)
        monkeypatch.setattr(pii, "edges_of", lambda nodes: (edges(nodes)[0], [], []))
        without += sum(map(len, pii.added_spans(text, base, field)))
        monkeypatch.setattr(pii, "edges_of", edges)
    assert right / added > 0.95 and right / wanted > 0.95 and without == 0


def test_mentions_alike_in_shape_and_word_before():
    texts = [f"Server 10.0.0.{k} replaced server 10.0.1.{k}, version 1.2.{k}." for k in range(100)]
    field = pii.fit(texts)

    def added(text, end):
        return [text[s:e] for s, e in pii.added_spans(text, [[], [(7, end)], [], []], field)[1]]

    assert added("Server 100.20.30.40 replaced server 100.20.300.40, version 1.2.3", 19) == []
    assert added("Server 100.20.30.140 replaced server 100.20.30.940, version 1.2.3", 20) == ["100.20.30.940"]
    assert added("Server 100.20.30.140 replaced Windows 100.20.30.940, version 1.2.3", 20) == []


def test_field_is_fitted_on_a_bounded_table(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(pii, "fit", seen.append)
    rows = [(k, f"number {k}") for k in range(500)] + [(None, "same 1")] * 300 + [(7, "no digits"), (8, None), (9, "")]
    pii.fitted(docs(*rows, extra=CLASHING))
    assert 5 <= len(seen[0]) <= 20 and len(set(seen[0])) == len(seen[0])
    pii.fitted(docs().limit(0))
    assert seen[1] == []


def test_registered_pii_query_on_repeated_and_no_rows(spark, docs, tmp_path):
    docs((1, "a@b.cd 1.2.3.4"), (1, "a@b.cd 1.2.3.4"), (1, "none"), (None, None)).write.parquet(f"{tmp_path}/a/documents.parquet")
    found = pii.op6_skip_chain_pii(spark, f"{tmp_path}/a").collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip) for r in found) == [(0, 0, 0), (1, 0, 0), (1, 1, 1), (1, 1, 1)]
    docs().limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert pii.op6_skip_chain_pii(spark, f"{tmp_path}/b").count() == 0


def test_license_rows_keep_their_own_labels(spark, tmp_path, docs):
    mit = next(t for _, t in licenses.NOTICES if t.startswith("Permission is hereby"))
    rows = [
        (1, mit[:78] + "\n" + mit[78:]), (2, mit), (5, "nothing here"), (5, "Licensed under CC BY 4.0"), (6, "Licensed under CC BY-NC 4.0"),
        (None, "nothing"), (None, "Licensed under CC BY 4.0"), (7, "licensed under the GNU Lesser General Public License, version 3"),
        (8, "Licensed under CC BY-NC 4.0\nLicensed under CC BY 4.0"), (9, "licensed under the GNU General Public License, version 3"),
    ]
    docs(*rows, extra=CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(((r.doc_id or 0, r.labels, r.base_labels, r.score) for r in licenses.op9_license_scan(spark, str(tmp_path)).collect()))
    assert found == [
        (0, "", "", 0.0), (0, "cc-by-4.0", "", 1.0), (1, "mit", "", 1.0), (2, "mit", "", 1.0), (5, "", "", 0.0), (5, "cc-by-4.0", "", 1.0),
        (6, "cc-by-nc-4.0", "", 1.0), (7, "gpl,lgpl", "gpl", 1.0), (8, "cc-by-4.0,cc-by-nc-4.0", "", 1.0), (9, "gpl,gpl-3", "gpl", 1.0),
    ]


def test_license_contract_equals_brute_force(spark, tmp_path, docs):
    rng = random.Random(14)
    parts = ["MIT", "License", "license", "apache", "General", "PUBLIC", "-", "x", "ümit", "mit\u00a0license", "\n", "the", "4.0", "é"]
    parts += [t for _, t in licenses.NOTICES]
    rows = [(rng.choice([None, *range(40)]), "".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", ", ", ""]) for _ in range(rng.randint(0, 25)))) for _ in range(150)]
    rows += [(50, None), (51, ""), (52, "mit license " * 20_000)]
    docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = licenses.op9_license_scan(spark, str(tmp_path)).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expected = []
    for k, text in rows:
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").translate(low))
        places = [(i, label) for i in range(len(words)) for label, own in licenses.PHRASES.items() if words[i : i + len(own)] == own]
        starts = [i for i, _ in places]
        expected.append((-1 if k is None else k, len(words), len(places), min(starts, default=-1), max(starts, default=-1), ",".join(sorted({x for _, x in places}))))
    own = [tuple(-1 if x is None else x for x in (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in found]
    assert sorted(own) == sorted(expected)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in found)
