"""Repeated passages across documents, by a compacted de Bruijn graph of word windows.

Edges of the graph are windows of EDGE consecutive words. The graph is cut by minimizers: the
smallest-hashed seed of SEED words inside a window names its part, and the neighbouring
windows of a document with one seed form a path, which is handled as a whole. Equal windows
have equal seeds, so each part of the graph is complete in one task. Runs of repeated windows
that go on in each other are compacted to spans, and a span counts only if the words at its
source are the same.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclens.llm.minhash import chunks, mix
from doclens.llm.shared import documents, words_of, written

EDGE, SEED = 13, 6
WIDTH = EDGE - SEED + 1
#: Bytes of a window's fingerprint. Windows are only compared when their 64-bit seeds agree.
MARK = 6
#: Characters of text for each part of the graph; a part's task reads about twice as many bytes.
PART_CHARS = 32 << 20
#: Contents of paths that a task remembers as repeated at most; beyond that it forgets them all.
MEMO_PATHS = 200_000

_BASE = np.uint64(0xD1342543DE82EF95)
_SALT = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Mixed hash of each run of size words."""
    n = len(hashes) - size + 1
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = value * _BASE + hashes[k : k + n]
    return mix(value)


def paths(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, count, seed) of each path, and the window hashes of all paths, one after the other.

    A path is a longest run of windows of one document with the same seed at the same place;
    first is its first window's place in the document. There are at most WIDTH windows in one.
    """
    lengths = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if len(hashes) < EDGE:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    seeds = _rolled(hashes, SEED)
    n = len(hashes) - EDGE + 1
    best, place = seeds[:n].copy(), np.zeros(n, np.int8)
    for k in range(1, WIDTH):
        other = seeds[k : k + n]
        lower = other < best
        best[lower] = other[lower]
        place[lower] = k
    docs = np.repeat(np.arange(len(lengths)), lengths)[:n]
    at = np.arange(n)
    whole = at + EDGE <= offsets[1:][docs]
    at, docs = at[whole], docs[whole]
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = at + place[whole]
    starts = np.ones(len(at), bool)
    starts[1:] = (anchor[1:] != anchor[:-1]) | (docs[1:] != docs[:-1])
    head = np.flatnonzero(starts)
    counts = np.diff(np.append(head, len(at)))
    windows = _rolled(hashes, EDGE)[at]
    return docs[head], at[head] - offsets[:-1][docs[head]], counts, best[at[head]], windows


def _packed(*columns: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def _unpacked(blob: bytes, *types: type) -> list[np.ndarray]:
    raw = zlib.decompress(blob)
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    out, at = [], 0
    for t in types:
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(raw[at : at + size], t))
        at += size
    return out


PARTS = "part int, seeds binary, places binary, marks binary, sure binary"
#: Columns of packed paths: document, version of its text, first window, windows.
PLACE = (np.int64, np.int64, np.uint32, np.uint8)
#: Columns of packed runs: a path and the document, version and first window of its source.
SURE = (*PLACE, np.int64, np.int64, np.uint32)


def cut(parts: int):
    """Task function: (doc_id, version, hashes) -> the paths of a stretch of documents, dealt to parts by seed.

    Of equal paths in the stretch only those of the smallest doc_id stand for all; the others
    are repeats for sure and travel as coordinates alone, to any part. Contents that repeat in
    a stretch are remembered for the next ones. So a passage that a third of all documents
    hold reaches its part about once for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            for part, values, offsets in chunks(batch.filter(pa.compute.is_valid(batch.column("doc_id"))), "hashes"):
                doc, first, count, seed, windows = paths(values.astype(np.uint64), offsets)
                if not len(doc):
                    continue
                ids, versions = part.column("doc_id").to_numpy()[doc], part.column("version").to_numpy()[doc]
                ends = np.cumsum(count)
                # A path's content: its windows in order.
                step = np.arange(len(windows)) - np.repeat(ends - count, count)
                content = np.add.reduceat(mix(windows + _SALT * (step + 1).astype(np.uint64)), ends - count) ^ seed
                order = np.lexsort((first, ids, content))
                new = np.ones(len(order), bool)
                new[1:] = content[order][1:] != content[order][:-1]
                group = np.cumsum(new) - 1
                leader = order[np.flatnonzero(new)]
                source = np.stack([ids[leader], versions[leader], first[leader]])
                several = np.bincount(group) > 1
                for g, c in enumerate(content[leader].tolist()):
                    known = memo.get(c)
                    if known is not None and known[0] < source[0, g]:
                        source[:, g] = known
                    elif several[g] or known is not None:
                        memo[c] = tuple(source[:, g].tolist())
                if len(memo) > MEMO_PATHS:
                    memo.clear()
                origin = np.zeros((3, len(order)), np.int64)
                origin[:, order] = source[:, group]
                stands = ids == origin[0]
                sure = np.flatnonzero(~stands)
                home = (seed % np.uint64(parts)).astype(np.int64)
                kept = np.flatnonzero(stands)
                kept = kept[np.argsort(home[kept], kind="stable")]
                edges = np.searchsorted(home[kept], np.arange(parts + 1))
                raw = windows.view(np.uint8).reshape(-1, 8)[:, :MARK]
                rows = []
                for p in np.flatnonzero(np.diff(edges)):
                    own = kept[edges[p] : edges[p + 1]]
                    # The windows of the paths in own, in order.
                    n = count[own]
                    which = np.repeat(ends[own] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    places = _packed(ids[own], versions[own], first[own].astype(np.uint32), n.astype(np.uint8))
                    rows.append((int(p), seed[own].tobytes(), places, raw[which].tobytes(), None))
                if len(sure):
                    coordinates = _packed(
                        ids[sure], versions[sure], first[sure].astype(np.uint32), count[sure].astype(np.uint8), *origin[:2, sure], origin[2, sure].astype(np.uint32)
                    )
                    rows.append((int(content[sure[0]] % np.uint64(parts)), None, None, None, coordinates))
                types = [pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["part", "seeds", "places", "marks", "sure"])

    return run


RUN = ("doc_id", "version", "first", "n", "source_id", "source_version", "source_first")
RUNS = ", ".join(f"{c} bigint" for c in RUN)


def _runs(*columns) -> pa.Table:
    return pa.Table.from_arrays([pa.array(np.asarray(c).astype(np.int64)) for c in columns], list(RUN))


def repeats(table: pa.Table) -> pa.Table:
    """One part of the graph: runs of windows that also start in a document with a smaller id.

    The source of a window is its smallest (doc_id, place); a run's windows follow each other
    in the document and in the source alike.
    """
    sure = [_unpacked(b, *SURE) for b in table.column("sure").to_pylist() if b]
    out = [_runs(*[np.concatenate(c) for c in zip(*sure, strict=True)])] if sure else []
    packed = [_unpacked(b, *PLACE) for b in table.column("places").to_pylist() if b]
    if packed:
        seeds = np.frombuffer(b"".join(b for b in table.column("seeds").to_pylist() if b), np.uint64)
        ids, versions, first, count = (np.concatenate(c) for c in zip(*packed, strict=True))
        marks = np.frombuffer(b"".join(b for b in table.column("marks").to_pylist() if b), np.uint8).reshape(-1, MARK)
        count, first = count.astype(np.int64), first.astype(np.int64)
        ends = np.cumsum(count)
        # Paths whose seed is that of other paths too.
        order = np.argsort(seeds, kind="stable")
        same = seeds[order][1:] == seeds[order][:-1]
        shared = np.zeros(len(seeds), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        kept = np.flatnonzero(shared)
        n = count[kept]
        local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        which = np.repeat(ends[kept] - n, n) + local
        wide = np.zeros((len(which), 8), np.uint8)
        wide[:, :MARK] = marks[which]
        mark, seed = wide.view(np.uint64).ravel(), np.repeat(seeds[kept], n)
        doc, version, place, path = np.repeat(ids[kept], n), np.repeat(versions[kept], n), np.repeat(first[kept], n) + local, np.repeat(kept, n)
        by = np.lexsort((place, version, doc, mark, seed))
        new = np.ones(len(by), bool)
        new[1:] = (mark[by][1:] != mark[by][:-1]) | (seed[by][1:] != seed[by][:-1])
        origin = np.zeros(len(by), np.int64)
        origin[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = np.flatnonzero(doc > doc[origin])
        if len(gone):
            at = origin[gone]
            source, source_version, source_place = doc[at], version[at], place[at]
            starts = np.ones(len(gone), bool)
            starts[1:] = (
                (path[gone][1:] != path[gone][:-1])
                | (place[gone][1:] != place[gone][:-1] + 1)
                | (source[1:] != source[:-1])
                | (source_version[1:] != source_version[:-1])
                | (source_place[1:] != source_place[:-1] + 1)
            )
            head = np.flatnonzero(starts)
            sizes = np.diff(np.append(head, len(gone)))
            out.append(_runs(doc[gone][head], version[gone][head], place[gone][head], sizes, source[head], source_version[head], source_place[head]))
    return pa.concat_tables(out) if out else _runs(*[[]] * len(RUN))


def versioned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, text): rows that share an id differ in version where their texts differ."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(doc_id, version, first, n, source_id, source_version, source_first): runs of windows that start in a smaller doc_id too."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    hashed = rows.select("doc_id", "version", F.transform(words_of("text"), lambda w: F.xxhash64(w)).alias("hashes"))
    dealt = hashed.mapInArrow(cut(parts), PARTS)
    # As many partitions as parts: a partition's size does not grow with the input.
    return dealt.repartition(parts, "part").groupBy("part").applyInArrow(repeats, RUNS)


def compacted(runs: DataFrame) -> DataFrame:
    """Runs joined where one goes on in the next, in the document and in its source: nonbranching paths.

    (doc_id, version, first_word, n_words, source_id, source_version, source_first_word), in words.
    """
    own = W.partitionBy("doc_id", "version").orderBy("first", "source_id", "source_version", "source_first")
    follows = (
        (F.col("first") == F.lag(F.col("first") + F.col("n")).over(own))
        & (F.col("source_id") == F.lag("source_id").over(own))
        & (F.col("source_version") == F.lag("source_version").over(own))
        & (F.col("source_first") == F.lag(F.col("source_first") + F.col("n")).over(own))
    )
    numbered = runs.distinct().withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn(
        "span", F.sum("new").over(own)
    )
    return numbered.groupBy("doc_id", "version", "span").agg(
        F.min("first").alias("first_word"),
        (F.sum("n") + EDGE - 1).alias("n_words"),
        F.first("source_id").alias("source_id"),
        F.first("source_version").alias("source_version"),
        F.min("source_first").alias("source_first_word"),
    ).drop("span")


def words_digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


DIGESTS = "source_id bigint, source_version bigint, source_first_word bigint, n_words bigint, digest binary"


def _source_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "version", "wanted")]
        for doc_id, version, wanted, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            words = WORD.findall(text or b"")
            out += [(doc_id, version, w["first"], w["n"], words_digest(words[w["first"] : w["first"] + w["n"]])) for w in wanted]
        types = [pa.int64()] * 4 + [pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["source_id", "source_version", "source_first_word", "n_words", "digest"]
        )


def with_source_digests(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """spans with the digest of the words at their sources.

    Sources are asked once for each stretch, however many documents repeat it; their texts are
    found by a sort-merge join at every size.
    """
    asked = written(
        spans.select("source_id", "source_version", F.col("source_first_word").alias("first"), F.col("n_words").alias("n"))
        .distinct()
        .groupBy("source_id", "source_version")
        .agg(F.collect_list(F.struct("first", "n")).alias("wanted")),
        "asked-sources",
    )
    asked = asked.select(F.col("source_id").alias("doc_id"), F.col("source_version").alias("version"), "wanted")
    digests = rows.join(asked.hint("merge"), ["doc_id", "version"]).mapInArrow(_source_digests, DIGESTS)
    digests = written(digests.distinct(), "source-digests")
    return spans.join(digests, ["source_id", "source_version", "source_first_word", "n_words"])


CLEANED = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        spans_of = batch.column("spans").to_pylist()
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), spans_of, strict=True):
            words = WORD.findall(text or b"")
            n = len(words)
            if spans:
                change = np.zeros(n + 1, np.int64)
                for x in spans:
                    first, end = x["first_word"], x["first_word"] + x["n_words"]
                    if words_digest(words[first:end]) == x["digest"]:
                        change[first] += 1
                        change[end] -= 1
                keep = np.cumsum(change[:n]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compacted repeats of docs with the digest of the words at their sources (see compacted)."""
    rows = versioned(docs, id_col, text_col)
    spans = written(compacted(written(repeated_runs(rows), "repeated-runs")), "repeated-spans")
    return with_source_digests(spans, rows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): every row without the words of repeated spans.

    A word goes when a window of EDGE words over it also starts in a document with a smaller
    id; windows are those of the input. Spans of such windows go only where the row's words
    have the digest of the words at the source, so what merely hashes alike stays. Null and
    empty texts, and texts shorter than a window, lose nothing. Of rows that repeat an id none
    is smaller than the other, and each loses its own spans. Rows with a null id are compared
    with nothing. Other columns are left out; empty input gives an empty result.
    """
    found = repeated_spans(docs, id_col, text_col)
    by_doc = found.groupBy(F.col("doc_id").alias("span_id"), F.col("version").alias("span_version")).agg(
        F.collect_list(F.struct("first_word", "n_words", "digest")).alias("spans")
    )
    rows = versioned(docs, id_col, text_col)
    own = (rows["doc_id"] == by_doc["span_id"]) & (rows["version"] == by_doc["span_version"])
    return rows.join(by_doc, own, "left").select("doc_id", "text", "spans").mapInArrow(_clean, CLEANED)


def op4_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i + 1 : i + 13], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 12)) AS i FROM d WHERE len(words) >= 13)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS source FROM windows) WHERE source < doc_id),
places AS (SELECT DISTINCT doc_id, i + k AS i FROM gone, unnest(range(0, 13)) AS u(k)),
positions AS (SELECT doc_id, unnest(range(0, len(words))) AS i, unnest(words) AS w FROM d),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text, count(*) AS n
  FROM positions ANTI JOIN places USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
