"""Personal data: fixed patterns, and a skip-chain random field that carries their labels to like tokens."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.shared import documents, written

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: Rows that the field is fitted on at most: different texts, those with the smallest hashes of id and text.
SAMPLE_ROWS = 3000
#: Rounds of message passing, and the belief at which a token joins a kind.
ROUNDS, BELIEF = 10, 0.9
#: Means of the priors of the skip tables' diagonals, for like mentions and for those alike in shape and word before:
#: texts rarely repeat what the patterns find, so the data alone say little.
LIKE_PRIOR, ALIKE_PRIOR = 4.0, 2.0
#: Precision of the Gaussian priors of all parameters, and steps of the fit.
RIDGE, STEPS = 1.0, 300

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EVIDENCE = re.compile(r"[0-9@]")
_TRIM = ".,;:!?\"'()[]{}<>|"

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ outwards: in linear time, however long the runs."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[list[Span]]:
    """Spans of each kind of KINDS; matches that fail their check are dropped."""
    ips = [m.span() for m in _IP.finditer(text) if all(int(p) <= 255 if len(p) < 20 else not p.strip("0") or len(p.lstrip("0")) < 4 and int(p.lstrip("0")) <= 255 for p in m[0].split("."))]
    cards, phones = [], []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                phones.append(m.span())
    return [emails(text), ips, cards, phones]


def written_spans(spans: list[list[Span]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, own in zip(KINDS, spans, strict=True) for s, e in sorted(own))


# --- the field: nodes are tokens with a digit or an @; all other tokens are outside ---

N_FEATURES = 40


def features(token: str) -> list[int]:
    """Shape of a token: which of N_FEATURES hold."""
    digits = sum(c.isdigit() for c in token)
    found = [0, 1 + min(digits, 20)]
    found += [22 + min(token.count("."), 3), 26 + min(token.count("-"), 2), 29 + min(len(token) // 8, 3)]
    if "@" in token:
        found.append(33)
    if any(c.isalpha() for c in token):
        found.append(34)
    if token[0] == "+":
        found.append(35)
    if "(" in token or ")" in token:
        found.append(36)
    return found


_CUE = re.compile(r"[^\W\d_]{2,}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]")

#: Digits from the end that like numbers share, and digits that a number in several tokens has at most.
SUFFIX, MOST_DIGITS = 7, 15
_NUMBER = re.compile(r"[+()0-9./-]*[0-9][+()0-9./-]*")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def digits_of(text: str) -> str:
    return _NOT_DIGIT.sub("", text) if text.isascii() else "".join(c for c in text if c.isdigit())


def keys_of(text: str) -> list[str]:
    """What like mentions share: the local part before an @ (or what follows a leading one); all digits, of six or more; the last SUFFIX digits."""
    if "@" in text:
        word = text.strip(_TRIM).lower()
        return ["@" + (word.partition("@")[0] or word[1:])] if word.strip("@") else []
    digits = digits_of(text)
    if len(digits) < 6:
        return []
    return [digits] if len(digits) < SUFFIX or len(digits) > MOST_DIGITS else [digits, "~" + digits[-SUFFIX:]]


def alike_key(before: str, token: str) -> str | None:
    """What mentions alike share: the shape of the token and the word before it."""
    cue = before.strip(_TRIM)
    if not _CUE.fullmatch(cue):
        return None
    return f"^{cue.lower()} " + _LETTER.sub("a", _DIGIT.sub("9", token.strip(_TRIM)))


class Node(NamedTuple):
    start: int
    end: int
    token: str
    label: int
    order: int
    #: Tokens that it takes the places of: one, but for numbers written in several.
    width: int
    keys: list[str]


def nodes_of(text: str, spans: list[list[Span]]) -> list[Node]:
    """Tokens with evidence, in order; order is the first token's place among all tokens.

    The last token of a span of several tokens has the keys of the whole span besides its own;
    its tokens have no key by shape, which is for mentions of one token.
    A number outside the spans that is written in several tokens is one node where it is like
    a phone of the text.
    """
    cover = sorted((s, e, k) for k, own in enumerate(spans) for s, e in own)
    found, at, before, token = [], 0, "", ""
    for order, m in enumerate(_TOKEN.finditer(text)):
        before, token = token, m[0]
        if not _EVIDENCE.search(token):
            continue
        start, end = m.span()
        while at < len(cover) and cover[at][1] <= start:
            at += 1
        inside = at < len(cover) and cover[at][0] < end
        keys = keys_of(token)
        if inside and cover[at][1] <= end:
            keys = list(dict.fromkeys(keys + keys_of(text[cover[at][0] : cover[at][1]])))
        if not inside or start <= cover[at][0] and cover[at][1] <= end:
            keys += [key for key in [alike_key(before, token)] if key]
        found.append(Node(start, end, token, cover[at][2] if inside else OUTSIDE, order, 1, keys))
    return joined_numbers(text, found, [text[s:e] for s, e in spans[KINDS.index("phone")]])


def joined_numbers(text: str, nodes: list[Node], phones: list[str]) -> list[Node]:
    """nodes, with neighbouring number tokens as one where their digits together are like those of a phone.

    Like is: the last SUFFIX digits are equal. The number goes on to the left as long as one
    of the two, without leading zeros, ends with the other.
    """
    like = defaultdict(set)
    for phone in phones:
        like[digits_of(phone)[-SUFFIX:]].add(digits_of(phone))
    if not like:
        return nodes
    out: list[Node] = []
    for node in nodes:
        out.append(node)
        if node.label != OUTSIDE or not _NUMBER.fullmatch(node.token.strip(_TRIM)):
            continue
        digits, best = digits_of(node.token), 0
        if len(digits) > MOST_DIGITS:
            continue
        for back in range(1, len(out)):
            left, right = out[-1 - back], out[-back]
            if left.label != OUTSIDE or left.width > 1 or left.order + 1 != right.order or not _NUMBER.fullmatch(left.token.lstrip(_TRIM)):
                break
            longer = digits_of(left.token) + digits
            if len(longer) > MOST_DIGITS:
                break
            if len(longer) >= SUFFIX:
                own = longer.lstrip("0")
                if not any(len(own) >= SUFFIX and (d.endswith(own) or own.endswith(d)) for d in like.get(longer[-SUFFIX:], ())):
                    break
                best = back
            digits = longer
        if best:
            first = out[-1 - best]
            start, end = bare(text, first.start, node.end)
            token = text[start:end]
            del out[-1 - best :]
            out.append(Node(start, end, token, OUTSIDE, first.order, best + 1, keys_of(token)))
    return out


def bare(text: str, start: int, end: int) -> Span:
    """The span without the punctuation around it; brackets that close inside stay."""
    outer = _TRIM.replace("(", "").replace(")", "")
    while True:
        if text[start] in outer or text[start] == "(" and ")" not in text[start : end - 1]:
            start += 1
        elif text[end - 1] in outer or text[end - 1] == ")" and "(" not in text[start:end]:
            end -= 1
        else:
            return start, end


def edges_of(nodes: list[Node]) -> tuple[list[Span], list[Span], list[Span]]:
    """Chain edges between neighbouring nodes, and skip edges from each node to the one before it with one of its keys.

    A node outside the spans has a skip edge to one inside as well: the last before it, or the
    first after it. Skip edges come in two lists, of like mentions and of those that are only
    alike in shape and word before.
    """
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1].order == nodes[i].order + nodes[i].width]
    like, alike, last, inside, waiting = {}, {}, {}, {}, defaultdict(list)
    for i, node in enumerate(nodes):
        for key in node.keys:
            skip = alike if key[0] == "^" else like
            if key in last:
                skip[last[key], i] = None
            last[key] = i
            if node.label != OUTSIDE:
                skip |= dict.fromkeys((j, i) for j in waiting.pop(key, ()))
                inside[key] = i
            elif key in inside:
                skip[inside[key], i] = None
            else:
                waiting[key].append(i)
    return chain, list(like), [edge for edge in alike if edge not in like]


def carried(nodes: list[Node]) -> dict[str, set[int]]:
    """The kinds that nodes inside spans give to each key; endings of numbers carry phones only."""
    kinds: dict[str, set[int]] = defaultdict(set)
    for node in nodes:
        if node.label != OUTSIDE:
            for key in node.keys:
                if key[0] != "~" or KINDS[node.label] == "phone":
                    kinds[key].add(node.label)
    return kinds


def kinds_for(node: Node, kinds: dict[str, set[int]]) -> set[int]:
    return set().union(*(kinds.get(key, ()) for key in node.keys))


class Field:
    """Potentials: unary by shape, and a table for each kind of edge: chain, like, alike (log scale)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, like: np.ndarray, alike: np.ndarray):
        self.unary, self.chain, self.like, self.alike = unary, chain, like, alike


def fit(texts: list[str]) -> Field:
    """The field by pseudo-likelihood: each node's label given those of its neighbours, on the patterns' own labels.

    A token outside the patterns whose like is inside one somewhere in its text counts as
    unlabelled, not as outside: it is what the field is to decide, so it takes no part.
    """
    size = OUTSIDE + 1
    shapes, labels, ends = [], [], [[], [], []]
    for text in texts:
        if not _EVIDENCE.search(text):
            continue
        spans = base_spans(text)
        nodes = nodes_of(text, spans)
        kinds = carried(nodes)
        place = {}
        for i, node in enumerate(nodes):
            if node.label != OUTSIDE or not kinds_for(node, kinds):
                place[i] = len(labels)
                shapes.append(features(node.token))
                labels.append(node.label)
        for own, edges in zip(ends, edges_of(nodes), strict=True):
            own += [(place[i], place[j]) for i, j in edges if i in place and j in place]
        # What a whole span looks like, for numbers in other spellings that are one node.
        for label, own in enumerate(spans):
            for whole in (text[s:e] for s, e in own):
                if _TOKEN.fullmatch(whole) is None:
                    shapes.append(features(whole))
                    labels.append(label)
    x = np.zeros((len(labels), N_FEATURES))
    for k, own in enumerate(shapes):
        x[k, own] = 1
    y = np.eye(size)[np.array(labels, int)]
    # Labels of a node's neighbours by kind of edge: to the right, to the left, like, alike.
    near = [np.zeros((len(labels), size)) for _ in range(4)]
    for k, own in enumerate(ends):
        first, second = np.array(own, int).reshape(-1, 2).T
        np.add.at(near[0 if k == 0 else k + 1], first, y[second])
        np.add.at(near[1 if k == 0 else k + 1], second, y[first])
    prior = [np.zeros((N_FEATURES, size)), np.zeros((size, size)), LIKE_PRIOR * np.eye(size), ALIKE_PRIOR * np.eye(size)]
    if not labels:
        prior[0][0, OUTSIDE] = 5.0
        return Field(*prior)
    value = [p.copy() for p in prior]
    mean, square = [np.zeros_like(p) for p in prior], [np.zeros_like(p) for p in prior]
    for step in range(1, STEPS + 1):  # Adam
        unary, chain, like, alike = value
        score = x @ unary + near[0] @ chain.T + near[1] @ chain + near[2] @ like + near[3] @ alike
        p = np.exp(score - score.max(axis=1, keepdims=True))
        g = y - p / p.sum(axis=1, keepdims=True)
        slopes = [x.T @ g, g.T @ near[0] + near[1].T @ g, near[2].T @ g, near[3].T @ g]
        for k, slope in enumerate(slopes):
            if k >= 2:
                slope = slope + slope.T
            slope = slope - RIDGE * (value[k] - prior[k])
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope * slope
            value[k] = value[k] + 0.1 / (1 + step / 50) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return Field(*value)


def beliefs(unary: np.ndarray, edges: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Loopy sum-product: label probabilities of each node. tables: one for each edge, rows by its first end."""
    n, size = unary.shape
    if not len(edges):
        out = unary - unary.max(axis=1, keepdims=True)
        out = np.exp(out)
        return out / out.sum(axis=1, keepdims=True)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    pair = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(source), size))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        into = (belief[source] - messages[back])[:, :, None] + pair
        top = into.max(axis=1)
        fresh = top + np.log(np.exp(into - top[:, None, :]).sum(axis=1))
        fresh -= fresh.max(axis=1, keepdims=True)
        messages = 0.5 * messages + 0.5 * fresh
    belief = unary.copy()
    np.add.at(belief, target, messages)
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[list[Span]], field: Field) -> list[list[Span]]:
    """Spans of tokens outside the patterns that the field labels; tokens inside keep their label.

    A token's kind must come to it over a skip edge, so some like token of the same document
    carries it by a pattern; a document without base spans gets none.
    """
    more: list[list[Span]] = [[] for _ in KINDS]
    if not any(base):
        return more
    nodes = nodes_of(text, base)
    lists = edges_of(nodes)
    kinds = carried(nodes)
    open_nodes = {i: own for i, node in enumerate(nodes) if node.label == OUTSIDE and (own := kinds_for(node, kinds))}
    if not open_nodes:
        return more
    unary = np.zeros((len(nodes), OUTSIDE + 1))
    for i, node in enumerate(nodes):
        unary[i] = field.unary[features(node.token)].sum(axis=0)
        if node.label != OUTSIDE:
            unary[i] = -50.0
            unary[i, node.label] = 50.0
    edges = np.array(sum(lists, []), int).reshape(-1, 2)
    tables = np.concatenate([np.repeat(t[None], len(own), 0) for t, own in zip((field.chain, field.like, field.alike), lists, strict=True)])
    belief = beliefs(unary, edges, tables)
    taken = sorted(s for own in base for s in own)
    for i, own in open_nodes.items():
        start, end, token = nodes[i][:3]
        kind = int(belief[i].argmax())
        if nodes[i].width == 1:
            start, end = start + len(token) - len(token.lstrip(_TRIM)), end - len(token) + len(token.rstrip(_TRIM))
        if kind in own and kind != OUTSIDE and belief[i, kind] >= BELIEF and start < end:
            if not any(s < end and start < e for s, e in taken):
                more[kind].append((start, end))
    return more


FOUND = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
)


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and those that the field adds, of every row of docs.

    Offsets count code points, ends are exclusive. The counts and base_sha256 are of the base
    spans alone, spans holds all. Null and empty texts have none; repeated rows are searched
    each; null ids are kept; other columns are left out; empty input gives an empty result.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if not text or not _EVIDENCE.search(text):
                    out.append((0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0))
                    continue
                base = base_spans(text)
                more = added_spans(text, base, field)
                every = [b + m for b, m in zip(base, more, strict=True)]
                digest = hashlib.sha256(written_spans(base).encode()).hexdigest()
                out.append((*map(len, base), digest, written_spans(every), sum(map(len, more))))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(search, FOUND)


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field, fitted on SAMPLE_ROWS rows at most that hold a digit or an @, whole texts.

    Rows are chosen by a hash of id and text below a limit that leaves about SAMPLE_ROWS of
    them, and rows equal in both count once; so the sample is a small table before any of it
    reaches the driver, however many tasks there are.
    """
    rows = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    n = rows.count()
    limit = int(min(1.0, SAMPLE_ROWS / n if n else 1.0) * 2**62)
    chosen = rows.where(F.shiftrightunsigned("h", 2) <= limit).groupBy("h").agg(F.min("text").alias("text"))
    sample = written(chosen, "pii-sample").orderBy("h").limit(SAMPLE_ROWS)
    return fit([r.text for r in sample.collect()])


def op6_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_pii(docs, fitted(docs))
