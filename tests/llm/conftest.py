import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """docs((id, text, source), ...): a documents table; text and source may be left out."""

    def make(*rows, extra=None):
        full = [(r[0], r[1] if len(r) > 1 else None, "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in extra or []:
            df = df.withColumn(name, df["n_chars"])
        return df

    return make


CLASHING = ["host", "words", "node", "class_id", "bands", "sig", "mix_rate", "mix_copy", "ids", "score", "piece", "bin", "shard", "first", "runs", "labels", "text_sha256", "keep_id", "kept", "spans"]
