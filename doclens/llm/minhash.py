"""Near-duplicate classes by ProbMinHash, banding and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.components import components, relabelled
from doclens.llm.shared import documents, words_of, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
#: Matching components below which a pair is not similar: 4.5 standard deviations under the mean of a pair at
#: the limit, which is missed with probability 7e-6, below what the bands miss.
SAFE_MATCHES = int(COMPONENTS * SIMILARITY - 4.5 * (COMPONENTS * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
#: Words handled at once in a task; a longer document is handled alone.
CHUNK_WORDS = 500_000
#: Rounds in which every bucket compares its members with one pivot.
PIVOT_ROUNDS = 2
#: Buckets of at most SMALL members list their pairs by a join; the others are compared in blocks of about
#: BLOCK_ROWS members and BLOCK_BYTES of shingle sets, each block with each.
SMALL, BLOCK_ROWS, BLOCK_BYTES = 8, 2048, 16 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, count), sorted by both, of documents given as word hashes from offsets[d] to offsets[d + 1].

    A document of fewer words than a shingle has one, of all its words; one without words has none.
    """
    lengths = np.diff(offsets)
    docs = np.repeat(np.arange(len(lengths)), lengths)
    n = len(hashes)
    if n == 0:
        return docs, hashes.astype(np.uint64), docs
    padded = np.concatenate([hashes.astype(np.uint64), np.zeros(SHINGLE - 1, np.uint64)])
    left = offsets[1:][docs] - np.arange(n)  # words from here to the document's end
    value = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        value = value * _BASE + np.where(left > k, padded[k : k + n], np.uint64(0))
    short = np.minimum(left, SHINGLE).astype(np.uint64)
    starts = np.arange(n) == offsets[:-1][docs]
    use = (left >= SHINGLE) | (starts & (lengths[docs] < SHINGLE))
    value, docs = mix(value + short * _GOLDEN)[use], docs[use]
    order = np.lexsort((value, docs))
    value, docs = value[order], docs[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(first)
    return docs[at], value[at], np.diff(np.append(at, len(value)))


def signatures(docs: np.ndarray, items: np.ndarray, weights: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """ProbMinHash: for each document and component, the item whose Poisson arrival came first.

    Every item starts a Poisson process of its weight's rate; each arrival picks one of the m
    components, which keeps its earliest arrival. An item ends as soon as its next arrival is
    later than all of its document's components hold. Two documents agree in a component with
    the probability Jaccard of their weights.
    """
    time = np.full(n_docs * m, np.inf)
    item = np.zeros(n_docs * m, np.uint64)
    limit = np.full(n_docs, np.inf)
    live, x, step = np.arange(len(items)), np.zeros(len(items)), np.zeros(1, np.uint64)
    while len(live):
        step += _GOLDEN
        z = mix(items[live] + step)
        x = x - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[live]
        ahead = x < limit[docs[live]]
        live, x, z = live[ahead], x[ahead], z[ahead]
        slot = docs[live] * m + (mix(z + _BASE) % np.uint64(m)).astype(np.int64)
        np.minimum.at(time, slot, x)
        won = time[slot] == x
        item[slot[won]] = items[live[won]]
        limit = time.reshape(n_docs, m).max(axis=1)
    return item.reshape(n_docs, m)


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the values and offsets of a list column, of about CHUNK_WORDS values each."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK_WORDS, "right")) - 1)
        end = min(end, len(batch))
        part = offsets[start : end + 1]
        yield batch.slice(start, end - start), values[part[0] : part[-1]], part - part[0]
        start = end


def digest_of(hashes: np.ndarray) -> bytes:
    """A 128-bit digest of a word sequence, given as 64-bit hashes of its words."""
    return hashlib.blake2b(np.ascontiguousarray(hashes).tobytes(), digest_size=16).digest()


SIGNED = "row_no bigint, doc_id bigint, text_hash bigint, digest binary, bands array<bigint>, sig binary"


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_no, doc_id, text_hash, hashes) -> SIGNED; digest is null and bands are empty without words."""
    for batch in batches:
        for part, values, offsets in chunks(batch, "hashes"):
            n = len(part)
            docs, items, counts = shingles(values, offsets)
            found = signatures(docs, items, counts.astype(np.float64), n)
            has = np.diff(offsets) > 0
            keys = np.zeros((n, BANDS), np.uint64)
            for k in range(ROWS):
                keys = keys * _BASE + found.reshape(n, BANDS, ROWS)[:, :, k]
            keys = mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN).view(np.int64)
            short = (mix(found + _GOLDEN) >> np.uint64(48)).astype(np.uint16)
            digests = [digest_of(values[offsets[i] : offsets[i + 1]]) if has[i] else None for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in ("row_no", "doc_id", "text_hash")],
                    pa.array(digests, pa.binary()),
                    pa.array([keys[i] if has[i] else [] for i in range(n)], pa.list_(pa.int64())),
                    pa.array([short[i].tobytes() for i in range(n)], pa.binary()),
                ],
                ["row_no", "doc_id", "text_hash", "digest", "bands", "sig"],
            )


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, digest, hashes) -> (node, items, counts) of the rows whose words have that digest."""
    for batch in batches:
        for part, values, offsets in chunks(batch, "hashes"):
            docs, items, counts = shingles(values, offsets)
            cuts = np.searchsorted(docs, np.arange(len(part) + 1))
            rows = [
                (node, items[cuts[i] : cuts[i + 1]].tobytes(), packed_weights(counts[cuts[i] : cuts[i + 1]]))
                for i, (node, digest) in enumerate(zip(part.column("node").to_pylist(), part.column("digest").to_pylist(), strict=True))
                if digest == digest_of(values[offsets[i] : offsets[i + 1]])
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                ["node", "items", "counts"],
            )


def packed_weights(counts: np.ndarray) -> bytes:
    """Counts as bytes; none where all are 1."""
    return counts.astype(np.int32).tobytes() if counts.max(initial=1) > 1 else b""


def weights_of(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, np.int32) if packed else np.ones(n, np.int32)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common items i of 1 / sum over j of max(a_j / a_i, b_j / b_i); items sorted and distinct.

    Equals the Jaccard similarity of the item sets where all weights are 1.
    """
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return len(common) / (len(a) + len(b) - len(common))
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    order = np.argsort(-(x / y), kind="stable")
    x, y = x[order], y[order]
    # By falling ratio: items before i count by their weight in a, those after by theirs in b.
    from_a = float(wa.sum()) - x.sum() + np.cumsum(x)
    from_b = float(wb.sum()) - np.cumsum(y)
    return float((1.0 / (from_a / x + from_b / y)).sum())


PAIR_COLUMNS = ["a", "b", "ca", "cb"]
PAIR = "a bigint, b bigint, ca bigint, cb bigint"


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, ca, cb, sig_a, sig_b), the pairs whose signatures agree in SAFE_MATCHES components or more."""
    for batch in batches:
        left = np.frombuffer(b"".join(batch.column("sig_a").to_pylist()), np.uint16).reshape(-1, COMPONENTS)
        right = np.frombuffer(b"".join(batch.column("sig_b").to_pylist()), np.uint16).reshape(-1, COMPONENTS)
        keep = (left == right).sum(axis=1) >= SAFE_MATCHES
        yield batch.select(PAIR_COLUMNS).filter(pa.array(keep))


def both_sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b, ...) with table's columns for both nodes, as column_a and column_b."""
    for side in "ab":
        own = table.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(own, side)
    return pairs


def n_common(one: np.ndarray, two: np.ndarray) -> int:
    """How many numbers two sorted arrays of different numbers share, without a copy of either as a set."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if not len(small):
        return 0
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


class Sets:
    """Shingle sets of nodes in one task, and the components that similar pairs have joined so far."""

    def __init__(self, table: pa.Table):
        self.place = {n: k for k, n in enumerate(table.column("node").to_pylist())}
        self.items = [np.frombuffer(b, np.uint64) for b in table.column("items").to_pylist()]
        self.counts = table.column("counts").to_pylist()
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    def joins(self, a: int, b: int, ca: int, cb: int) -> bool:
        """Whether nodes a and b are similar and their components ca and cb not joined yet; then joins them."""
        ra, rb = self.top(ca), self.top(cb)
        if ra == rb:
            return False
        i, j = self.place[a], self.place[b]
        n, m = len(self.items[i]), len(self.items[j])
        if not self.counts[i] and not self.counts[j]:  # all weights are 1: plain Jaccard
            if min(n, m) < SIMILARITY * max(n, m) - 1e-9:
                return False
            common = n_common(self.items[i], self.items[j])
            value = common / (n + m - common)
        else:
            value = probability_jaccard(self.items[i], weights_of(self.counts[i], n), self.items[j], weights_of(self.counts[j], m))
        if value >= SIMILARITY:
            self.up[ra] = rb
        return value >= SIMILARITY


def same_bucket(table: pa.Table) -> pa.Table:
    """Similar pairs between two blocks of one bucket (or within one), enough to join all components that they join.

    Signatures are compared first. A pair that meets in several buckets is looked at in the
    one of the first band whose keys both have.
    """
    node, comp = table.column("node").to_pylist(), table.column("comp").to_numpy()
    band, one, two = (int(table.column(c)[0].as_py()) for c in ("band", "one", "two"))
    block = table.column("block").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, COMPONENTS)
    keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    sets, out = Sets(table), []
    second = np.flatnonzero(block == two)
    for i in np.flatnonzero(block == one).tolist():
        near = second[(second > i) | (one != two)]
        near = near[comp[near] != comp[i]]
        near = near[(sig[near] == sig[i]).sum(axis=1) >= SAFE_MATCHES]
        near = near[(keys[near] == keys[i]).argmax(axis=1) == band]
        for j in near.tolist():
            pair = (node[i], node[j], int(comp[i]), int(comp[j]))
            if sets.joins(*pair):
                out.append(pair)
    return pa.Table.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(4)], PAIR_COLUMNS)


def same_group(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Of a group's pairs, similar ones enough to join all components that its similar pairs join."""
    own = Sets(sets)
    keep = [own.joins(*pair) for pair in zip(*[pairs.column(c).to_pylist() for c in PAIR_COLUMNS], strict=True)]
    return pairs.select(PAIR_COLUMNS).filter(pa.array(keep, pa.bool_()))


def verified(likely: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar pairs among the likely ones (a, b, ca, cb), enough of them to join what they join.

    Pairs with one b (a pivot, mostly) are verified together, dealt to groups by a so that a
    group's shingle sets are about BLOCK_BYTES; each set reaches a group once.
    """
    sizes = sets.select("node", F.octet_length("items").alias("bytes"))
    of_a = likely.join(sizes.withColumnRenamed("node", "a"), "a")
    groups = written(of_a.groupBy("b").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("groups")), "verify-groups")
    dealt = written(
        likely.join(groups, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.greatest("groups", F.lit(1)))).withColumn("star", F.col("b")),
        "dealt-pairs",
    )
    needed = written(
        dealt.select("star", "part", F.col("a").alias("node")).union(dealt.select("star", "part", F.col("b").alias("node"))).distinct(),
        "needed-sets",
    )
    own = sets.join(needed, "node")
    found = dealt.select("star", "part", *PAIR_COLUMNS).groupBy("star", "part").cogroup(own.groupBy("star", "part")).applyInArrow(same_group, PAIR)
    return written(found, "links")


def crossing(live: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components of one bucket, over all of their pairs."""
    sizes = sets.select("node", F.octet_length("items").alias("bytes"))
    size = live.join(sizes, "node").groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES))
    sized = written(live.join(size.select("key", "n", blocks.alias("blocks")), "key"), "sized-members")
    listed = sized.where(F.col("n") <= SMALL)
    other = listed.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"))
    pairs = listed.join(other, "key").where("comp <> cb and node < b").select(F.col("node").alias("a"), "b", F.col("comp").alias("ca"), "cb")
    likely = both_sides(pairs.distinct(), sigs, ["sig"]).mapInArrow(agreeing, PAIR)
    by_join = verified(written(likely, "likely-pairs"), sets)
    # Every block of a bucket meets every other and itself: a member goes along once for each.
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    meets = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    large = sized.where(F.col("n") > SMALL).withColumn("block", block).withColumn("meets", meets)
    large = large.select("key", "band", "node", "comp", "block", F.least("block", "meets").alias("one"), F.greatest("block", "meets").alias("two"))
    grouped = large.join(sigs, "node").join(sets, "node").groupBy("key", "one", "two").applyInArrow(same_bucket, PAIR)
    return written(by_join.unionByName(grouped), "links")


def linked_nodes(members: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, comp) over the similar pairs among all nodes that share a bucket (key, band).

    In each of PIVOT_ROUNDS rounds, every bucket that still holds several components elects a
    pivot, and the members outside the pivot's component are compared with it. First that is
    the member with the most company in all its buckets: in a group of edited copies the text
    that they were made from, so that the group falls into one component at one pair a member;
    then a random member. Then all pairs of different
    components in a bucket are compared, so no candidate pair is left out; only similar ones
    leave the task that compares a bucket.
    """
    steps = []
    sizes = written(members.groupBy("key").agg(F.count("*").alias("n")), "bucket-sizes")
    company = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("company"))
    live = written(members.join(company, "node").withColumn("comp", F.col("node")), "live-members")
    for step in range(PIVOT_ROUNDS + 1):
        if step:
            moved = relabelled(live, "comp", steps[-1])
            mixed = moved.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
            live = written(moved.join(mixed.select("key"), "key"), "live-members")
            if live.isEmpty():
                break
        # Links are between components: what was joined in earlier rounds is one node here.
        if step == PIVOT_ROUNDS:
            found = crossing(live, sigs, sets)
        else:
            rank = F.struct((F.xxhash64("node", F.lit(step)) if step else -F.col("company")).alias("rank"), "node", "comp")
            pivots = live.groupBy("key").agg(F.min(rank).alias("p")).select("key", F.col("p.node").alias("b"), F.col("p.comp").alias("cb"))
            pairs = live.join(pivots, "key").where("comp <> cb").select(F.col("node").alias("a"), "b", F.col("comp").alias("ca"), "cb")
            likely = both_sides(pairs.distinct(), sigs, ["sig"]).mapInArrow(agreeing, PAIR)
            found = verified(written(likely, "likely-pairs"), sets)
        steps.append(components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    nodes = members.select("node").distinct().withColumn("comp", F.col("node"))
    for labels in steps:
        nodes = relabelled(nodes, "comp", labels)
    return nodes


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, class_id, class_size, stays): classes of documents linked by near-duplicate pairs.

    A pair is near-duplicate when the probability Jaccard of its counted five-word shingles is
    SIMILARITY or more; candidates share one of BANDS bands of ROWS ProbMinHash components
    (a pair at the limit is missed with probability 5e-5) and each is verified exactly. Equal
    word sequences (by a 128-bit digest) are one node, so copies are never expanded into
    pairs. class_id is the smallest doc_id of the class; stays holds for one row of each class,
    one with that id. Null and empty texts are classes of their own; texts of fewer than five
    words are one shingle; repeated rows return repeated rows; a null id is never a class_id
    unless all of its class are null. With row_col, a number that tells rows apart, the result
    has it as row_no, and all rows with the number of the one that stays do so. Other columns are left out; empty input gives an empty result.
    """
    hashes = F.transform(words_of("text"), lambda w: F.xxhash64(w)).alias("hashes")
    rows = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).cast("bigint").alias("row_no"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    signed = written(rows.select("row_no", "doc_id", "text_hash", hashes).mapInArrow(sign, SIGNED), "signatures")
    # The row that stands for a node: smallest id, nulls last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no", "text_hash")).alias("first")
    nodes = written(
        signed.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(first, F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    bands = nodes.select(F.posexplode("bands").alias("band", "key"), "node")
    shared = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    members = written(bands.join(written(shared, "shared-keys"), "key").select("key", "band", "node"), "members")
    candidates = written(members.select("node").distinct(), "candidates")
    sigs = written(nodes.join(candidates, "node", "left_semi").select("node", "bands", "sig"), "candidate-sigs")
    texts = nodes.join(candidates, "node", "left_semi").select(
        "node", "digest", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")
    )
    # Rows are found again by the hash of their text and their id; a row of another digest is left out.
    # The texts are shuffled for this at every size, also where the candidates could be broadcast.
    sets = written(
        rows.join(written(texts, "candidate-texts").hint("merge"), (F.col("text_hash") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
        .select("node", "digest", hashes)
        .mapInArrow(gather, "node bigint, items binary, counts binary")
        .groupBy("node")
        .agg(F.first("items").alias("items"), F.first("counts").alias("counts")),
        "shingle-sets",
    )
    comps = linked_nodes(members, sigs, sets)
    classed = nodes.select("digest", "node", "first", "n").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = classed.groupBy("comp").agg(F.min("first").alias("best"), F.sum("n").alias("class_size"))
    verdicts = written(
        classed.select("digest", "comp").join(sizes, "comp").select(
            "digest", F.col("best.doc_id").alias("class_id"), F.col("best.row_no").alias("best_row"), "class_size"
        ),
        "classes",
    )
    return signed.select("row_no", "doc_id", "digest").join(verdicts, "digest", "left").select(
        "doc_id",
        F.when(F.col("best_row").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"),
        F.coalesce(F.col("row_no") == F.col("best_row"), F.lit(True)).alias("stays"),
        *(["row_no"] if row_col else []),
    )


def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))
