"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.shared import documents, written

#: Labelled rows of each class that the index holds at most: those with the smallest hashes of their id.
SAMPLE_PER_CLASS = 2000
NEIGHBOURS = 15
BLOCK_DOCS = 64
#: A term that one in so many examples has is kept as whole rows of weights rather than as a list of postings.
DENSE_SHARE = 16
#: Blocks that a search scores before it knows what the nearest examples have at least.
HEAD_BLOCKS = 4
#: Cosines are compared to so many decimals: what is closer counts as a tie.
DECIMALS = 6
THRESHOLD = 0.7
#: Counts of so many terms travel as one row.
SLICE_TERMS = 8192

WORD = re.compile(r"[^\W\d_]+")


class Vocabulary:
    """All words of the labelled examples: the terms."""

    def __init__(self, examples: list[dict[str, int]]):
        self.places = {t: k for k, t in enumerate(sorted({w for words in examples for w in words}))}

    def __len__(self) -> int:
        return len(self.places)

    def vector(self, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the terms among counted words, in order, and how often each occurs."""
        places = self.places
        known = [(places[w], n) for w, n in words.items() if w in places]
        ids, times = np.array(known, np.int64).reshape(-1, 2).T
        order = np.argsort(ids)
        return ids[order], times[order].astype(float)


def words_in(text: str | None) -> dict[str, int]:
    return Counter(WORD.findall((text or "").lower()))


VECTORS = "doc_id bigint, ids array<int>, counts array<int>"


def vectors_of(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, counts) of the terms in every row's text, written once."""
    shipped = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shipped.value
        for batch in batches:
            found = [vocabulary.vector(words_in(text)) for text in batch.column("text").to_pylist()]
            offsets = pa.array(np.cumsum([0, *[len(i) for i, _ in found]]).astype(np.int32))
            columns = [pa.array(np.concatenate([v[k] for v in found] or [np.zeros(0)]).astype(np.int32)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.ListArray.from_arrays(offsets, c) for c in columns]], ["doc_id", "ids", "counts"]
            )

    return written(rows.mapInArrow(extract, VECTORS), "term-vectors")


def each_vector(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and counts of each row of a batch of vectors."""
    lists = batch.column("ids")
    offsets = lists.offsets.to_numpy()
    ids = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = batch.column("counts").values.to_numpy(zero_copy_only=False).astype(float)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield ids[a:b], counts[a:b]


def document_frequencies(vectors: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and documents in all, over all rows.

    Tasks count their own rows and send slices of SLICE_TERMS counts, which are added up by
    slice; as many counts as there are terms reach the driver.
    """
    slices = -(-size // SLICE_TERMS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slices * SLICE_TERMS, np.int64)
        n = 0
        for batch in batches:
            n += len(batch)
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(total))
        parts = [total[s * SLICE_TERMS : (s + 1) * SLICE_TERMS] for s in range(slices)]
        held = [s for s, part in enumerate(parts) if part.any()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *held], pa.int32()),
                pa.array([np.array([n], np.int64).tobytes(), *[parts[s].tobytes() for s in held]], pa.binary()),
            ],
            ["slice", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    frequency, n_docs = np.zeros(slices * SLICE_TERMS), 0
    counted = vectors.select("ids").mapInArrow(count, "slice int, counts binary")
    for r in counted.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        own = np.frombuffer(r.counts, np.int64)
        if r.slice < 0:
            n_docs = int(own[0])
        else:
            frequency[r.slice * SLICE_TERMS : (r.slice + 1) * SLICE_TERMS] = own
    return frequency[:size], n_docs


def relevance(ids: list[np.ndarray], toxic: np.ndarray, n_terms: int) -> np.ndarray:
    """How far each term's presence goes with the label in the examples: the size of their correlation."""
    a = np.bincount(np.concatenate([i for i, t in zip(ids, toxic, strict=True) if t] or [np.zeros(0, int)]), minlength=n_terms).astype(float)
    b = np.bincount(np.concatenate([i for i, t in zip(ids, toxic, strict=True) if not t] or [np.zeros(0, int)]), minlength=n_terms).astype(float)
    n1, n0 = float(toxic.sum()), float(len(toxic) - toxic.sum())
    spread = (a + b) * (n1 + n0 - a - b) * n1 * n0
    return np.where(spread > 0, np.abs(a * (n0 - b) - b * (n1 - a)) / np.sqrt(np.maximum(spread, 1)), 0)


def expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] places, then the same from starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class BlockMaxIndex:
    """Inverted lists of the examples' terms, in blocks of BLOCK_DOCS examples with the largest weight of each.

    Lists of terms that DENSE_SHARE and more of the examples have are stored as rows of weights,
    others as postings; both have the blocks' maxima. weight holds each term's inverse document frequency by its relevance; a vector's parts are
    that times one plus the logarithm of the count, to length 1. Terms of weight 0 have no list.
    """

    def __init__(self, doc_ids: np.ndarray, toxic: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray], weight: np.ndarray):
        self.weight = weight
        weighted = [self.weights(i, c) for i, c in zip(ids, counts, strict=True)]
        # Examples with the same leading terms stand together, so that blocks differ in their maxima.
        leads = [i[np.argsort(-w, kind="stable")[:2]].tolist() for i, w in zip(ids, weighted, strict=True)]
        order = sorted(range(len(ids)), key=lambda k: (leads[k], len(ids[k])))
        self.doc_ids, self.toxic = doc_ids[order], toxic[order]
        self.n = len(order)
        self.blocks = -(-self.n // BLOCK_DOCS)
        place = np.repeat(np.arange(self.n), [len(ids[k]) for k in order])
        term = np.concatenate([ids[k] for k in order]) if order else np.zeros(0, int)
        value = np.concatenate([weighted[k] for k in order]) if order else np.zeros(0)
        use = value > 0
        place, term, value = place[use], term[use], value[use]
        frequent = np.bincount(term, minlength=len(weight)) * DENSE_SHARE >= max(self.n, 1)
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        dense = frequent[term]
        self.rows = np.zeros((int(frequent.sum()), self.blocks * BLOCK_DOCS), np.float32)
        self.rows[self.row[term[dense]], place[dense]] = value[dense]
        self.row_max = self.rows.reshape(len(self.rows), self.blocks, BLOCK_DOCS).max(axis=2)
        place, term, value = place[~dense], term[~dense], value[~dense]
        by = np.lexsort((place, term))
        term, self.place, self.value = term[by], place[by], value[by]
        # Entries: a term's postings in one block.
        key = term * max(self.blocks, 1) + self.place // BLOCK_DOCS
        head = np.flatnonzero(np.diff(key, prepend=-1))
        self.entry_start = head
        self.entry_count = np.diff(np.append(head, len(key)))
        self.entry_block = self.place[head] // BLOCK_DOCS
        self.entry_max = np.maximum.reduceat(self.value, head) if len(head) else np.zeros(0)
        self.term_start = np.searchsorted(term[head], np.arange(len(weight) + 1))
        self.term_count = np.diff(self.term_start)

    def weights(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[ids]
        norm = np.sqrt((w * w).sum())
        return w / norm if norm else w

    def nearest(self, ids: np.ndarray, counts: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the NEIGHBOURS most similar examples and all that tie with the last, nearest first.

        The example at leave takes no part. Blocks with the highest bounds are scored first; a
        block whose bound is below the last neighbour's cosine then cannot hold a nearer
        example and is skipped.
        """
        w = self.weights(ids, counts)
        ids, w = ids[w > 0], w[w > 0]
        row = self.row[ids]
        row, in_rows = row[row >= 0], w[row >= 0].astype(np.float32)
        entries = self.term_count[ids]
        entry, own = expanded(self.term_start[ids], entries), np.repeat(w, entries)
        if not len(row) and not len(entry):
            return np.zeros(0, int), np.zeros(0)
        block = self.entry_block[entry]
        bound = np.bincount(block, own * self.entry_max[entry], minlength=self.blocks) + in_rows @ self.row_max[row]
        order = np.argsort(-bound, kind="stable")
        score = np.zeros((self.blocks, BLOCK_DOCS))

        def add(blocks: np.ndarray) -> None:
            wanted = np.zeros(self.blocks, bool)
            wanted[blocks] = True
            use = wanted[block]
            count = self.entry_count[entry[use]]
            at = expanded(self.entry_start[entry[use]], count)
            score.reshape(-1)[:] += np.bincount(self.place[at], np.repeat(own[use], count) * self.value[at], minlength=score.size)
            if 2 * len(blocks) > self.blocks:
                score[wanted] += (in_rows @ self.rows[row]).reshape(score.shape)[wanted]
            else:
                whole = self.rows.reshape(len(self.rows), self.blocks, BLOCK_DOCS)
                score[blocks] += (in_rows @ whole[row[:, None], blocks].reshape(len(row), len(blocks) * BLOCK_DOCS)).reshape(-1, BLOCK_DOCS)

        slack = 10.0**-DECIMALS
        add(order[:HEAD_BLOCKS])
        if leave >= 0:
            score[leave // BLOCK_DOCS, leave % BLOCK_DOCS] = 0
        head = score[order[:HEAD_BLOCKS]].ravel()
        last = float(np.partition(head, -NEIGHBOURS)[-NEIGHBOURS]) if len(head) >= NEIGHBOURS else 0.0
        rest = order[HEAD_BLOCKS:]
        rest = rest[bound[rest] >= max(last - slack, slack)]
        if len(rest):
            add(rest)
        score = score.ravel()[: self.n]
        near = np.round(score, DECIMALS)
        if leave >= 0:
            near[leave] = 0
        places = np.flatnonzero(near > 0)
        if len(places) > NEIGHBOURS:
            floor = np.partition(near[places], -NEIGHBOURS)[-NEIGHBOURS]
            places = places[near[places] >= floor]
        places = places[np.lexsort((self.doc_ids[places], -near[places]))]
        return places, near[places]

    def features(self, ids: np.ndarray, counts: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(1, vote, nearness of toxic examples), and the neighbours' places and cosines."""
        places, near = self.nearest(ids, counts, leave)
        if not len(places):
            return np.array([1.0, 0.0, 0.0]), places, near
        votes = near * near
        toxic = near[self.toxic[places]]
        share = float((toxic * toxic).sum() / votes.sum())
        return np.array([1.0, share, float(toxic.max()) if len(toxic) else 0.0]), places, near


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic fit by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - 0.1 * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, words, counts)."""
    for batch in batches:
        found = [words_in(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([list(f) for f in found], pa.list_(pa.string())),
                pa.array([list(f.values()) for f in found], pa.list_(pa.int64())),
            ],
            ["doc_id", "words", "counts"],
        )


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, int, dict[str, int]]], dict[int, float]]:
    """Examples (doc_id, toxic, counted words) of the folds other than 1, and each class's rows per example."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(
        F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = written(usable, "train-labels")
    totals = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = [
        usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for label in (0, 1)
    ]
    ids = written(chosen[0].unionByName(chosen[1]), "examples")
    # At most SAMPLE_PER_CLASS ids of each class are broadcast. Rows that repeat an id: the first text in order.
    texts = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    label_of = {r.doc_id: r.toxic for r in ids.collect()}
    rows = [
        (r.doc_id, label_of[r.doc_id], dict(zip(r.words, r.counts, strict=True)))
        for r in texts.mapInArrow(counted_words, "doc_id bigint, words array<string>, counts array<bigint>").collect()
    ]
    held = Counter(label for _, label, _ in rows)
    return sorted(rows, key=lambda r: r[0]), {k: totals.get(k, 0) / held[k] for k in held}


SCORED = "doc_id bigint, score double, evidence array<struct<doc_id: bigint, toxic: int, cosine: double>>"


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of docs.

    Examples are a bounded sample of the training folds (SAMPLE_PER_CLASS rows of each class),
    with whole texts. Terms are all their words; document frequencies are
    counted over all documents. A term weighs its inverse document frequency times its
    relevance. A score is the calibrated vote of the NEIGHBOURS nearest examples (and those
    that tie with the last) by exact TF-IDF cosine, weighted by the squared cosine; evidence
    holds the nearest three. A text without any of the terms (empty and null texts too) has no
    neighbours and gets the calibrated score of no vote. Repeated rows are scored each; a
    null id counts as not held out; without examples of both classes all scores are the
    share of toxic labels. Extra columns are left out; empty input gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    examples, class_weight = training_rows(rows, labels)
    toxic = np.array([label == 1 for _, label, _ in examples], bool)
    both = bool(toxic.any() and not toxic.all())
    vocabulary = Vocabulary([words for _, _, words in examples] if both else [])
    known = [vocabulary.vector(words) for _, _, words in examples]
    ids, counts = [v[0] for v in known], [v[1] for v in known]
    vectors = vectors_of(rows, vocabulary)
    frequency, n_docs = document_frequencies(vectors, len(vocabulary)) if both else (np.zeros(0), 0)
    weight = (np.log((1 + n_docs) / (1 + frequency)) + 1e-3) * relevance(ids, toxic, len(vocabulary)) if both else np.zeros(0)
    index = BlockMaxIndex(np.array([e[0] for e in examples], np.int64), toxic, ids, counts, weight)
    beta = np.zeros(3)
    if both:
        at = {int(d): k for k, d in enumerate(index.doc_ids)}
        x = np.array([index.features(i, c, at[e[0]])[0] for e, i, c in zip(examples, ids, counts, strict=True)])
        beta = logistic(x, toxic.astype(float), np.array([class_weight[int(t)] for t in toxic]))
    else:
        total = sum(class_weight[int(t)] for t in toxic)
        share = sum(class_weight[1] for t in toxic if t) / total if total else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        beta[0] = np.log(share / (1 - share))
    shipped = spark.sparkContext.broadcast((index, beta))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, beta = shipped.value
        evidence_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        for batch in batches:
            scores, evidence = [], []
            for vector in each_vector(batch):
                features, places, near = index.features(*vector)
                scores.append(float(1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))))
                evidence.append([
                    {"doc_id": int(index.doc_ids[p]), "toxic": int(index.toxic[p]), "cosine": float(c)} for p, c in zip(places[:3], near[:3], strict=True)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, evidence_type)],
                ["doc_id", "score", "evidence"],
            )

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    return vectors.mapInArrow(score, SCORED).select(
        "doc_id",
        F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "evidence",
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
