"""Best-fit packing of documents into sequences, under conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.shared import BLANKS, documents, words_of, written

CAPACITY = 2048
SHARD_ROWS = 4096
PACKED = "doc_id bigint, piece bigint, first_word bigint, n_words bigint, shard bigint, bin bigint, bin_offset bigint, no_id boolean"


def best_fit(items: Iterable[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source bit, cluster bit) item, in the order given.

    Open bins are ordered by residual. The search starts at the successor of the item's size
    and goes on to larger residuals until a bin is compatible: one whose source and cluster
    bitmaps share no bit with the item's. A bit of 0 conflicts with nothing. Without a
    compatible bin the item opens one.
    """
    order: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for size, source, cluster in items:
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not (sources[b] & source or clusters[b] & cluster):
                break
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        placed.append((b, capacity - residual))
        sources[b] |= source
        clusters[b] |= cluster
        insort(order, (residual - size, b))
    return placed


def _bits(values: pd.Series) -> list[int]:
    codes, _ = pd.factorize(values)  # nulls get -1
    return [1 << int(c) if c >= 0 else 0 for c in codes]


def pack_shard(rows: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Packs the pieces of one shard, largest first, then by id and piece; what still ties in source and cluster is alike."""
    order = ["n_words", "doc_id", "no_id", "piece", "first_word", "cluster", "source"]
    rows = rows.sort_values(order, ascending=[False] + [True] * 6, kind="stable")
    items = zip(rows["n_words"].astype(int), _bits(rows["source"]), _bits(rows["cluster"]), strict=True)
    placed = best_fit(items, capacity)
    out = rows[["doc_id", "piece", "first_word", "n_words", "shard", "no_id"]].copy()
    out.insert(5, "bin", [b for b, _ in placed])
    out.insert(6, "bin_offset", [o for _, o in placed])
    return out


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
) -> DataFrame:
    """Best-fit-decreasing bins of at most capacity words, in which no two pieces conflict.

    Two pieces conflict when they share a source or a duplicate cluster: the values of
    cluster_col, or else equal texts (blanks aside). Texts without words are in no cluster.
    A document longer than the capacity is cut into pieces; every piece comes back once, as
    (doc_id, piece, first_word, n_words, shard, bin, bin_offset): bin counts from 0 within
    its shard. Shards are dealt by a hash of all that tells pieces apart, so that a hot source,
    cluster or id spreads over all of them; each is packed by one task and holds about
    shard_rows pieces. Bins do not depend on the order of the rows. Null and empty texts are a piece of no words; a null source conflicts with none;
    repeated rows are packed each; null ids are kept. Empty input gives an empty result.
    """
    content = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANKS, "")
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.when(content != "", F.substring(F.sha2(content, 256), 1, 32))
    sizes = written(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            cluster.alias("cluster"),
            F.size(words_of(text_col)).cast("bigint").alias("total"),
        )
        .groupBy("doc_id", "source", "cluster", "total")
        .agg(F.count("*").alias("rows")),
        "piece-sizes",
    )
    last = F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0).cast("bigint"))
    pieces = sizes.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    )
    n_pieces = sizes.agg(F.sum(F.col("rows") * (last + 1))).first()[0] or 0
    shards = max(1, -(-n_pieces // shard_rows))
    dealt = pieces.select(
        F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("doc_id"),  # pandas would make floats of null ids
        F.col("doc_id").isNull().alias("no_id"),
        "source",
        "cluster",
        "piece",
        (F.col("piece") * capacity).alias("first_word"),
        F.least(F.lit(capacity).cast("bigint"), F.col("total") - F.col("piece") * capacity).alias("n_words"),
        F.pmod(F.xxhash64("doc_id", "source", "cluster", "total", "copy", "piece"), F.lit(shards)).alias("shard"),
    )
    packed = dealt.groupBy("shard").applyInPandas(lambda rows: pack_shard(rows, capacity), PACKED)
    return packed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
