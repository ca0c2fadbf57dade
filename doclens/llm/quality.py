"""Quality rules with host verdicts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.shared import BLANKS, documents, words_of, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Limits of the further rules. In a suspect host they decide, elsewhere they only count.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 15
#: A host is suspect when its shrunken failure rate is above SUSPECT_RATE, or SUSPECT_RATIO times the pooled rate.
SUSPECT_RATE, SUSPECT_RATIO = 0.5, 1.25
#: Bounds of the fitted prior's strength (its a + b), in documents.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0

#: Column that holds a row of the input whole, for callers that go on with it.
ROW = "input_row"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per document with the rule measures, made in one pass without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW),
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        words_of(text_col).alias("words"),
        lines.alias("lines"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
    )
    hashed = split.select(
        ROW,
        "doc_id",
        "host",
        "word_chars",
        "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = hashed.withColumn(
        "windows",
        F.when(
            F.size("hashes") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Windows are sorted with their places only in documents that repeat one.
    ordered = windows.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("windows", "hashes")

    def same(k, other):
        return F.col("ordered")[k]["h"] == F.col("ordered")[other]["h"]

    repeated = ordered.withColumn(
        "starts",
        F.sort_array(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.size("ordered") - 1),
                    lambda k: ((k > 0) & same(k, F.greatest(k - 1, F.lit(0))))
                    | ((k < F.size("ordered") - 1) & same(k, F.least(k + 1, F.size("ordered") - 1))),
                ),
                lambda k: F.col("ordered")[k]["i"],
            )
        ),
    )
    empty = F.size("ordered") == 0
    return repeated.select(
        ROW,
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.when(empty, F.lit(0).cast("bigint"))
        .otherwise(
            F.aggregate(
                "starts",
                F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("covered")),
                lambda acc, i: F.struct(
                    i.alias("last"), (acc["covered"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("covered")
                ),
                lambda acc: acc["covered"],
            )
        )
        .alias("n_repeat_words"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """Adds base_failed and rule_failed (any rule of a document) to measured rows."""
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    strict = (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
        | (F.col("word_chars") < MIN_MEAN_WORD * F.col("n_words"))
        | (F.col("word_chars") > MAX_MEAN_WORD * F.col("n_words"))
    )
    return rows.withColumn("base_failed", base).withColumn("rule_failed", base | strict)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate, suspect): failure rates by host, shrunk to an empirical beta prior.

    The prior has the pooled failure rate as its mean; its strength follows from the spread
    of the hosts' own rates by the method of moments, within MIN_STRENGTH and MAX_STRENGTH. So
    a host of few documents, or among hosts that hardly differ, needs more to become suspect.
    """
    hosts = written(
        rows.groupBy("host").agg(
            F.count("*").alias("n_docs"), F.count_if(F.col("rule_failed")).alias("n_failed")
        ),
        "hosts",
    )
    # The moments are one row, whatever the number of hosts.
    m = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.count("*").alias("n"),
        F.sum(F.col("n_failed") / F.col("n_docs")).alias("s1"),
        F.sum(F.pow(F.col("n_failed") / F.col("n_docs"), F.lit(2.0))).alias("s2"),
    ).first()
    mean = m["mean"] or 0.0
    spread = (m["s2"] - 2 * mean * m["s1"] + m["n"] * mean * mean) / m["n"] if m["n"] else 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else MAX_STRENGTH
    strength = min(MAX_STRENGTH, max(MIN_STRENGTH, strength))
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("suspect", F.col("rate") > min(SUSPECT_RATE, SUSPECT_RATIO * mean))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep_rows: bool = False
) -> DataFrame:
    """Rule measures and verdict of every document, with its host's verdict.

    A document that fails a base rule (too few words, too many words in repeated 8-word
    windows) goes. In a suspect host one goes also when it fails a strict rule (symbols,
    repeated lines, mean word length); a document that fails no rule is kept whatever its
    host. One row per input row. Null text has no words; null hosts are one host; rows that
    repeat an id are judged each; other columns are left out, but with keep_rows each row
    carries its input whole, as the struct input_row, so that nothing has to be joined back.
    Empty input gives an empty result.
    """
    rows = measured(docs, id_col, text_col, host_col)
    # A generator keeps the optimizer from copying the measures into every use of them.
    every = F.explode(F.array(F.struct(*[c for c in rows.columns if c != ROW])))
    rows = judged(rows.select(ROW, every.alias("m")).select(ROW, "m.*"))
    # With the inputs the measures would be a copy of all texts: they are made twice instead of written.
    rows = rows if keep_rows else written(rows.drop(ROW), "measures")
    suspects = host_verdicts(rows).where("suspect").select(F.col("host").alias("bad_host"), "suspect")
    joined = rows.join(suspects, rows["host"].eqNullSafe(suspects["bad_host"]), "left")
    suspect = F.coalesce("suspect", F.lit(False))
    return joined.select(
        "doc_id",
        *MEASURES,
        "base_failed",
        (~F.col("base_failed") & ~(suspect & F.col("rule_failed"))).alias("kept"),
        "rule_failed",
        suspect.alias("host_suspect"),
        *([ROW] if keep_rows else []),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT doc_id, source,
         list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols
  FROM t),
k AS (SELECT *, row_number() OVER () AS row_no FROM s),
windows AS (
  SELECT row_no, i, array_to_string(words[i + 1 : i + 8], ' ') AS w
  FROM (SELECT row_no, words, unnest(range(0, len(words) - 7)) AS i FROM k WHERE len(words) >= 8)),
starts AS (
  SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, w) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT row_no, sum(least(8, i - coalesce(last_i, i - 8))) AS n_repeat_words
  FROM (SELECT row_no, i, lag(i) OVER (PARTITION BY row_no ORDER BY i) AS last_i FROM starts) GROUP BY row_no),
m AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM k LEFT JOIN covered USING (row_no)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
j AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS rule_failed FROM b),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (rule_failed) AS f FROM j GROUP BY source),
pooled AS (SELECT sum(f) / sum(n) AS mean FROM hosts),
spread AS (SELECT any_value(mean) AS mean, avg(pow(f / n - mean, 2)) AS v FROM hosts, pooled),
prior AS (
  SELECT mean, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, mean * (1 - mean) / v - 1)) ELSE 1000.0 END AS strength FROM spread),
verdict AS (SELECT source, (f + mean * strength) / (n + strength) > least(0.5, 1.25 * mean) AS suspect FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (suspect AND rule_failed) AS kept, rule_failed, suspect AS host_suspect
FROM j JOIN verdict ON j.source IS NOT DISTINCT FROM verdict.source
"""
