"""Findings: dedup, prevalence, verdicts, and joins across artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclens.operators.anchored import anchored_candidates
from doclens.operators.held import held_labels
from doclens.sources.tables import written

SEVERITIES = ["info", "low", "medium", "high"]


def union_findings(families: list[DataFrame]) -> DataFrame:
    """Findings of all families, with nulls for columns that a family lacks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)


def first_per_key(findings: DataFrame, by_rule: bool = False) -> DataFrame:
    """The first finding of each description of an artifact, or of each rule and description.

    An aggregate rather than a window: a description that a third of the rows share is combined before the shuffle.
    """
    keys = ["artifact_id", "description", *(["rule_id"] if by_rule else [])]
    rest = [c for c in findings.columns if c not in keys]
    best = F.min(F.struct("seq", *[c for c in rest if c != "seq"])).alias("first")
    return findings.groupBy(*keys).agg(best).select(*keys, "first.*")


def _drop_known_of_many(findings: DataFrame, by_rule: bool) -> DataFrame:
    """drop_known for artifacts of very many findings.

    Equal descriptions and equal containers are combined first. A description then meets only
    those texts of its artifact that hold its rarest gram there and are no shorter, and is looked
    for in them: an artifact of very many findings is dealt out by grams, not compared in pairs.
    """
    texts = findings.select("artifact_id", "seq", F.explode(F.array("description", "indication")).alias("text")).where("text is not null")
    held = texts.groupBy("artifact_id", "text").agg(F.min("seq").alias("text_seq"))
    held = written(held.withColumn("text_key", F.xxhash64("artifact_id", "text")), "finding-texts")
    first = written(first_per_key(findings, by_rule).withColumn("pattern_id", F.xxhash64("artifact_id", "description")), "first-findings")
    scope = F.xxhash64("artifact_id").alias("scope")
    patterns = first.select("pattern_id", F.col("description").alias("pattern"), scope).distinct()
    pairs = anchored_candidates(held.select("text_key", F.col("text").alias("t"), scope), patterns)
    own = first.select(F.col("artifact_id").alias("own_id"), "pattern_id", F.col("description").alias("own"), F.col("seq").alias("own_seq"))
    met = pairs.join(own, "pattern_id").join(held, "text_key").where(F.col("artifact_id").eqNullSafe(F.col("own_id")) & (F.col("text_seq") < F.col("own_seq")))
    known = met.where((F.length("text") >= F.length("own")) & F.contains("text", F.col("own")))
    # An empty description lies in any text.
    least = held.groupBy("artifact_id").agg(F.min("text_seq").alias("text_seq"))
    empty = own.where("own = ''").join(least, F.col("own_id").eqNullSafe(F.col("artifact_id"))).where("text_seq < own_seq")
    gone = known.select("own_id", "own", "own_seq").unionByName(empty.select("own_id", "own", "own_seq")).distinct()
    same = F.col("artifact_id").eqNullSafe(F.col("own_id")) & (F.col("description") == F.col("own")) & (F.col("seq") == F.col("own_seq"))
    return first.join(gone, same, "left_anti").select(*findings.columns)


#: Findings of an artifact, and characters of their texts, up to which they are compared in pairs.
PAIRED_ROWS, PAIRED_CHARS = 1000, 8 << 20


def drop_known(findings: DataFrame, by_rule: bool = False) -> DataFrame:
    """Findings whose description no earlier finding of the artifact holds, in either column.

    An artifact's findings meet each other in a join that moves each text once, by artifact alone;
    those of an artifact with very many findings or characters (and of a null id) are dealt out by grams.
    """
    chars = F.coalesce(F.length("description"), F.lit(0)) + F.coalesce(F.length("indication"), F.lit(0))
    sizes = findings.groupBy("artifact_id").agg(F.count("*").alias("n"), F.sum(chars).alias("chars"))
    many = written(sizes.where((F.col("n") > PAIRED_ROWS) | (F.col("chars") > PAIRED_CHARS) | F.col("artifact_id").isNull()).select(F.col("artifact_id").alias("many_id")), "artifacts-of-many")
    some = not many.isEmpty()
    own = findings.where("artifact_id is not null")
    own = own.join(many, F.col("artifact_id") == F.col("many_id"), "left_anti") if some else own
    later, earlier = own.alias("later"), own.alias("earlier")
    held = F.contains("earlier.description", F.col("later.description")) | F.contains("earlier.indication", F.col("later.description"))
    known = (F.col("earlier.artifact_id") == F.col("later.artifact_id")) & (F.col("earlier.seq") < F.col("later.seq")) & held
    kept = first_per_key(later.join(earlier.hint("merge"), known, "left_anti"), by_rule).select(*findings.columns)
    if not some:
        return kept
    rest = findings.join(many, F.col("artifact_id").eqNullSafe(F.col("many_id")), "left_semi")
    return kept.unionByName(_drop_known_of_many(rest, by_rule))


def dedup_findings(findings: DataFrame, mode: str = "exact", by_rule: bool = False) -> DataFrame:
    """K1: exact keeps the first of equal descriptions (of a rule, with by_rule); contains also drops those held by an earlier finding."""
    if mode == "exact":
        return first_per_key(findings, by_rule)
    if mode == "contains":
        return drop_known(findings, by_rule)
    raise ValueError(f"mode is exact or contains, not {mode}")


def join_strings(strings: DataFrame, separator: str = ", ") -> DataFrame:
    """A1: an artifact's strings in order of position, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return strings.groupBy("artifact_id").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), separator).alias("joined"))


def first_last(strings: DataFrame) -> DataFrame:
    """A4: first and last value of an artifact, by position."""
    return strings.groupBy("artifact_id").agg(F.min_by("value", "pos").alias("first_value"), F.max_by("value", "pos").alias("last_value"))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """A5: findings of each severity, by artifact."""
    return findings.groupBy("artifact_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES])


def rule_prevalence(findings: DataFrame) -> DataFrame:
    """Artifacts and findings by family and rule, with subtotals."""
    family = F.regexp_extract("rule_id", "^([A-Z]+)", 1)
    return findings.withColumn("family", family).rollup("family", "rule_id").agg(
        F.countDistinct("artifact_id").alias("n_artifacts"), F.count("*").alias("n_findings")
    )


def verdict(findings: DataFrame) -> DataFrame:
    """The highest severity of an artifact."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    top = findings.groupBy("artifact_id").agg(F.max(rank).alias("rank"))
    return top.select("artifact_id", F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank").cast("int")).alias("verdict"))


def top_risky(findings: DataFrame, k: int = 20) -> DataFrame:
    """L3: the k artifacts with the highest scores (high 100, medium 10, low 1)."""
    counts = severity_rollup(findings)
    score = F.col("n_high") * 100 + F.col("n_medium") * 10 + F.col("n_low")
    return counts.select("artifact_id", score.alias("score"), "n_high", "n_medium", "n_low").orderBy(F.desc("score"), "artifact_id").limit(k)


def first_findings(findings: DataFrame, n: int) -> DataFrame:
    """L2: the first n findings of each artifact in order."""
    order = W.partitionBy("artifact_id").orderBy("seq")
    return findings.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn")


def document_order(findings: DataFrame) -> DataFrame:
    """L1: findings in the order of their artifacts and places."""
    return findings.orderBy("artifact_id", "seq")


def duplicate_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts that share their sha256 with others, and how many there are."""
    groups = artifacts.groupBy("sha256").agg(F.count("*").alias("n_copies")).where("n_copies > 1")
    return artifacts.select("artifact_id", "sha256").join(groups, "sha256")


def shared_indicators(findings: DataFrame) -> DataFrame:
    """Descriptions that several artifacts share: counts and the first artifact, not all pairs."""
    return findings.groupBy("description").agg(
        F.countDistinct("artifact_id").alias("n_artifacts"), F.min("artifact_id").alias("first_artifact")
    ).where("n_artifacts > 1")


def match_signatures(parts: DataFrame, signatures: DataFrame) -> DataFrame:
    """(artifact_id, label) of the signatures (sig, label) that a part's lens text holds.

    For tables of any size: blocks of parts meet shards of signatures, and each place of a text is
    looked up among the signatures of each length. A part has a row for each row of signatures.
    """
    rows = signatures.where("label is not null").select("label", F.array("sig").alias("includes"), F.array().cast("array<string>").alias("excludes"))
    return held_labels(parts.select("artifact_id", "t"), rows, keep_text=False).select("artifact_id", F.explode("labels").alias("label"))
