"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.shared import documents, without, words_of, written

#: Exponent of the default target weights: token shares to this power, made to sum to 1.
TEMPERATURE = 0.5
SEED = "mix-1"
MIX_COLUMNS = ("mix_rate", "mix_copies", "mix_copy", "mix_key", "mix_source", "mix_salt", "mix_part", "mix_u")
#: Sources, of about 100 bytes each, whose rates are broadcast; more meet their documents by a salted join.
BROADCAST_SOURCES = 100_000
SALTS = 16


def unit_hash(*parts: str | Column) -> Column:
    """A number in (0, 1) that depends on the parts alone: 52 bits of their MD5."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def poisson_count(rate: Column, u: Column) -> Column:
    """How many of P(X <= 0), P(X <= 1), ... lie below u: the count that u inverts to.

    The probabilities are summed one after the other, as far as a 52-bit number can reach, and
    not kept; the steps are as many as the copies that the rate makes.
    """
    last = F.ceil(rate + 10 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.when(F.exp(-rate) < u, 1).otherwise(0).cast("bigint").alias("n"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(rate / k)
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), (acc["n"] + F.when(total < u, 1).otherwise(0)).alias("n"))

    found = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["n"])
    return F.when(rate > 0, found).otherwise(F.lit(0).cast("bigint"))


def source_rates(sizes: DataFrame, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """(source, rate): mean repetitions that bring each source to its share of the tokens.

    The total number of tokens stays what it is. Without weights, a source's target is its
    token share to the power temperature. A source without tokens, or absent from given
    weights, has rate 0.
    """
    per_source = written(
        sizes.groupBy("source").agg(F.sum("n_words").cast("double").alias("tokens")), "source-sizes"
    )
    if weights is None:
        wanted = per_source.withColumn("wanted", F.pow("tokens", F.lit(float(temperature))))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None)
        wanted = per_source.withColumn(
            "wanted", F.coalesce(given[F.col("source")].cast("double") if weights else F.lit(None), F.lit(0.0))
        )
    wanted = wanted.withColumn("wanted", F.when(F.col("tokens") > 0, F.col("wanted")).otherwise(0.0))
    total = wanted.agg(F.sum("tokens").alias("t"), F.sum("wanted").alias("w")).first()
    scale = (total.t or 0.0) / total.w if total.w else 0.0
    rated = wanted.select(
        "source",
        F.when(F.col("tokens") > 0, F.col("wanted") * F.lit(scale) / F.col("tokens")).otherwise(0.0).alias("rate"),
    )
    return written(rated, "source-rates")


def with_rates(docs: DataFrame, rates: DataFrame, source_col: str, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """docs with the mix_rate of their source, by null-safe equality; documents of a large source are not moved together."""
    if rates.count() <= broadcast_sources:
        return docs.join(F.broadcast(rates), docs[source_col].eqNullSafe(rates["mix_source"]))
    salted = docs.withColumn("mix_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    many = rates.withColumn("mix_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(many.hint("merge"), (salted["mix_salt"] == many["mix_part"]) & salted[source_col].eqNullSafe(many["mix_source"]))


def poisson_mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """Repeat every document a Poisson number of times so that sources meet target weights.

    The count inverts the Poisson distribution of the source's rate at a number hashed from
    seed and id, so it does not depend on order or partitions. Returns the columns of docs
    and mix_rate, mix_copies (the count), mix_copy (from 0) and mix_key, in the global
    random order of mix_key over the partitions. Null sources form a source of their own;
    null ids hash alike; null and empty texts have no tokens but follow their source's
    rate; rows that repeat an id get the same count. Columns of docs named
    mix_... as these are replaced. Empty input gives an empty result.
    """
    docs = without(docs, MIX_COLUMNS)
    sizes = docs.select(F.col(source_col).alias("source"), F.size(words_of(text_col)).alias("n_words"))
    rates = source_rates(sizes, weights, temperature).select(
        F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate")
    )
    drawn = with_rates(docs, rates, source_col, broadcast_sources)
    # A generator keeps the optimizer from drawing the number again for every step of the count.
    drawn = drawn.withColumn("mix_u", F.explode(F.array(unit_hash(F.lit(seed), id_col))))
    counted = drawn.withColumn("mix_copies", F.explode(F.array(poisson_count(F.col("mix_rate"), F.col("mix_u")))))
    copies = counted.where(F.col("mix_copies") > 0).withColumn(
        "mix_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("mix_copies") - 1))
    )
    keyed = copies.withColumn("mix_key", unit_hash(F.lit(seed + "-order"), id_col, "mix_copy"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The key is uniform, so equal stretches of it are equal parts, and no sample of it is needed.
    stretch = F.least(F.floor(F.col("mix_key") * parts), F.lit(parts - 1)).cast("int")
    return (
        keyed.select(*docs.columns, "mix_rate", "mix_copies", "mix_copy", "mix_key")
        .repartitionById(parts, stretch)
        .sortWithinPartitions("mix_key")
    )


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", F.round("mix_rate", 9).alias("mix_rate"), "mix_copies", "mix_copy", "mix_key")


OP8_SQL = r"""
WITH sizes AS (
  SELECT source, sum(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')))::DOUBLE AS tokens
  FROM documents GROUP BY source),
total AS (SELECT sum(tokens) AS t, sum(CASE WHEN tokens > 0 THEN pow(tokens, 0.5) ELSE 0 END) AS w FROM sizes),
rates AS (
  SELECT source, CASE WHEN tokens > 0 THEN pow(tokens, 0.5) * (t / w) / tokens ELSE 0 END AS rate FROM sizes, total),
logs AS (
  SELECT source, rate, k, CASE WHEN k = 0 THEN -rate ELSE -rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate / k) END) OVER (PARTITION BY source ORDER BY k) END AS lp
  FROM rates, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 40)::BIGINT + 1)) AS u(k) WHERE rate > 0),
cdf AS (SELECT source, rate, list(c ORDER BY k) AS cdf FROM (
  SELECT source, rate, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS c FROM logs) GROUP BY source, rate),
drawn AS (
  SELECT doc_id, d.source, rate, cdf,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
counted AS (SELECT doc_id, source, rate, len(list_filter(cdf, lambda c: c < u))::BIGINT AS n FROM drawn)
SELECT doc_id, source, round(rate, 9) AS mix_rate, n AS mix_copies, copy AS mix_copy,
       (('0x' || substr(md5('mix-1-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS mix_key
FROM counted, unnest(range(0, n)) AS c(copy)
"""
