"""A5 to A7 kept up to date: a ledger of signed counts, by which a new batch or a changed rule re-runs only its part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.operators.findings import SEVERITIES

KEYS = ["artifact_id", "rule_id", "severity"]


def signed_counts(findings: DataFrame, sign: int = 1) -> DataFrame:
    """Findings as counts by artifact, rule and severity, to add (1) or to take back (-1)."""
    return findings.groupBy(*KEYS).agg((F.count("*") * sign).alias("n"))


def with_verdict(counts: DataFrame) -> DataFrame:
    """Counts by severity with A7: the highest severity that has any; artifacts without findings go."""
    top = F.coalesce(*[F.when(F.col(f"n_{s}") > 0, s) for s in reversed(SEVERITIES)])
    return counts.withColumn("verdict", top).where("verdict is not null")


def updated(rollup: DataFrame, deltas: DataFrame) -> DataFrame:
    """A rollup (artifact_id, n_info to n_high, verdict) after signed counts: both are sums, so they add up."""
    names = [f"n_{s}" for s in SEVERITIES]
    more = deltas.select("artifact_id", *[F.when(F.col("severity") == s, F.col("n")).otherwise(0).alias(f"n_{s}") for s in SEVERITIES])
    both = rollup.select("artifact_id", *names).unionByName(more)
    return with_verdict(both.groupBy("artifact_id").agg(*[F.sum(n).alias(n) for n in names]))


class Ledger:
    """Signed counts of findings below a shared path, one folder a change, split by rule.

    A change (a batch, or a rule's new version) has a name. Repeating it under that name, as
    after a failure, replaces it, so nothing counts twice. A change of a rule reads that rule's
    folders only, takes back what no longer holds, and adds what is new; equal rows write
    nothing. artifact_id is a long. Null ids, rules and severities are kept as they are; a
    severity that is none of SEVERITIES is in prevalence, but not in the rollup.
    """

    SCHEMA = "artifact_id bigint, severity string, n bigint, change string, rule_id string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _changes(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        return sorted(n.removeprefix("change=") for n in names if n.startswith("change="))

    def rows(self, without: str | None = None) -> DataFrame:
        """(artifact_id, rule_id, severity, n) of all changes, or of all but one."""
        paths = [f"{self.path}/change={c}" for c in self._changes() if c != without]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA).select(*KEYS, "n")
        return self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(*paths).select(*KEYS, "n")

    def _write(self, counts: DataFrame, change: str) -> None:
        rows = counts.withColumn("artifact_id", F.col("artifact_id").cast("bigint")).where("n <> 0")
        rows.write.mode("overwrite").partitionBy("rule_id").parquet(f"{self.path}/change={change}")

    def add(self, findings: DataFrame, change: str) -> None:
        """The findings of new artifacts."""
        self._write(signed_counts(findings), change)

    def change_rule(self, rule_id: str, findings: DataFrame, change: str) -> None:
        """All findings of one rule as they are now, over all artifacts; what it found before is taken back."""
        now = signed_counts(findings.where(F.col("rule_id") == rule_id))
        before = self.rows(without=change).where(F.col("rule_id") == rule_id).withColumn("n", -F.col("n"))
        self._write(now.unionByName(before).groupBy(*KEYS).agg(F.sum("n").alias("n")), change)

    def current(self) -> DataFrame:
        """What holds after all changes: (artifact_id, rule_id, severity, n)."""
        return self.rows().groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n <> 0")

    def rollup(self) -> DataFrame:
        """A5 and A7 by artifact."""
        counts = [F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in SEVERITIES]
        return with_verdict(self.rows().groupBy("artifact_id").agg(*counts))

    def prevalence(self) -> DataFrame:
        """A6 by rule: artifacts and findings."""
        return self.current().groupBy("rule_id").agg(F.countDistinct("artifact_id").alias("n_artifacts"), F.sum("n").alias("n_findings"))

    def compacted(self, path: str) -> Ledger:
        """A ledger at a new path that holds the current counts as one change."""
        new = Ledger(self.spark, path)
        new._write(self.current(), "compacted")
        return new
