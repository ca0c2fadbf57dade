"""A6 and J8 over very many findings by mergeable sketches, kept by day, beside the exact forms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^14 registers: a relative standard error of 0.0081, and exact up to some thousand artifacts.
LOG_REGISTERS = 14
#: Descriptions that a frequent-item sketch tracks; a count is off by at most 3.5 / TRACKED of all rows.
TRACKED = 8192


def relative_error(log_registers: int = LOG_REGISTERS) -> float:
    """One standard error of a merged sketch's estimate."""
    return 1.04 / math.sqrt(2**log_registers)


def prevalence_sketches(findings: DataFrame, day: str, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(day, rule_id, sketch, n_findings): the artifacts of each rule and day. Sketches of days may be stored and merged."""
    by_day = findings.groupBy(F.col(day).alias("day"), "rule_id")
    return by_day.agg(F.hll_sketch_agg(F.col("artifact_id").cast("string"), log_registers).alias("sketch"), F.count("*").alias("n_findings"))


def prevalence(sketches: DataFrame) -> DataFrame:
    """A6 over any days: (rule_id, n_artifacts, n_findings), n_artifacts estimated. An artifact of several days counts once."""
    merged = sketches.groupBy("rule_id").agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n_findings").alias("n_findings"))
    return merged.select("rule_id", F.hll_sketch_estimate("sketch").alias("n_artifacts"), "n_findings")


def indicator_sketches(findings: DataFrame, day: str, tracked: int = TRACKED) -> DataFrame:
    """(day, sketch, n): the frequent descriptions of each day, as 64-bit hashes. Null descriptions do not count."""
    described = findings.where("description is not null").select(F.col(day).alias("day"), F.xxhash64("description").alias("item"))
    return described.groupBy("day").agg(F.expr(f"approx_top_k_accumulate(item, {tracked})").alias("sketch"), F.count("*").alias("n"))


def frequent_indicators(findings: DataFrame, sketches: DataFrame, share: float = 0.01, tracked: int = TRACKED) -> DataFrame:
    """Descriptions that make up more than a share of all findings: (description, n_findings, n_artifacts), exact.

    The merged sketches name the candidates, a few for each that share allows; a second pass
    counts these alone, so the rest is never shuffled. No description is missed while the
    sketch's error stays below half the share, which is checked. findings are the rows that the
    sketches were made of.
    """
    if not 2 * 3.5 / tracked < share <= 1:
        raise ValueError(f"share must be over {7 / tracked}: track more descriptions")
    k = min(tracked, math.ceil(2 / share) + 1)
    merged = sketches.agg(F.expr("approx_top_k_combine(sketch)").alias("sketch"), F.sum("n").alias("total"))
    candidates = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {k})")).alias("c"), "total").select("c.item", "total")
    # At most k rows.
    met = findings.where("description is not null").join(F.broadcast(candidates), F.xxhash64("description") == F.col("item"))
    counts = met.groupBy("description", "total").agg(F.count("*").alias("n_findings"), F.countDistinct("artifact_id").alias("n_artifacts"))
    return counts.where(F.col("n_findings") > F.col("total") * F.lit(share)).select("description", "n_findings", "n_artifacts")
