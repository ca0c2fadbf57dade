"""Keyed state of streams: what is forgotten, and findings in any order."""

from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from doclens.plans import registry
from doclens.streaming import state


def test_values_are_forgotten(spark, tmp_path):
    day = 86_400
    batches = [
        [("a", 1, day), ("c", 5, day), ("c", 6, day)],
        [("b", 2, 12 * day)],  # moves the watermark past the time that a is kept
        [("a", 3, 12 * day), ("b", 4, 12 * day + 60), (None, 9, 12 * day)],
    ]
    schema = "sha256 string, artifact_id long, s long"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    before = spark.conf.get(state.STATE_STORE[0])
    spark.conf.set(*state.STATE_STORE)
    try:
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        found = state.seen_before(read.withColumn("modificationTime", F.timestamp_seconds("s")), "sha256", keep_ms=day * 1000)
        q = found.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        state.run_to_end(q)
    finally:
        spark.conf.set(state.STATE_STORE[0], before)
    seen = spark.read.schema(found.schema).parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.value, r.artifact_id, r.first_artifact, r.n_before) for r in seen) == [("b", 4, 2, 1), ("c", 6, 5, 1)]


def test_first_texts_in_any_order():
    rows = [(3, "R", "s", "i", "part"), (1, "R", "s", "i", "long part"), (2, "R", "s", "holds word", "x"), (4, "R", "s", "i", "word"), (5, "R", "s", None, None)]
    assert [r[0] for r in state.first_texts(rows)] == [1, 2]


def test_findings_are_held_while_the_next_comes_within_the_delay(spark, tmp_path):
    """Findings of one artifact over 100 minutes, the last of them in a batch after the watermark has passed the first by an hour."""
    minute = 60
    batches = [
        [(1, 1, "long text", 0), (1, 2, "other", 50 * minute)],
        [(2, 1, "p", 125 * minute)],
        [(2, 2, "q", 126 * minute)],
        [(1, 3, "text", 100 * minute), (2, 3, "p", 126 * minute)],
        [(9, 1, "end", 900 * minute)],
    ]
    schema = "artifact_id long, seq long, description string, s long"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    before = spark.conf.get(state.STATE_STORE[0])
    spark.conf.set(*state.STATE_STORE)
    try:
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        timed = read.select("artifact_id", "seq", F.lit("R").alias("rule_id"), F.lit("s").alias("severity"), F.lit(None).cast("string").alias("indication"), "description", F.timestamp_seconds("s").alias("modificationTime"))
        found = state.dedup_contains_stream(timed)
        q = found.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        state.run_to_end(q)
    finally:
        spark.conf.set(state.STATE_STORE[0], before)
    kept = spark.read.schema(found.schema).parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.artifact_id, r.seq) for r in kept) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_a_value_costs_three_calls_of_state():
    """Rows of one value, seen for the first time: one look, one timer, one update, and no frame of its own."""
    calls = []
    seen = SimpleNamespace(get=lambda: calls.append("get"), update=lambda v: calls.append(v))
    handle = SimpleNamespace(getValueState=lambda *_: seen, registerTimer=lambda at: calls.append(at))
    processor = state.SeenValues(1000)
    processor.init(handle)
    rows = iter([Row(value="v", artifact_id=k, at=5000 + k) for k in (7, 3, 7)])
    found = processor.handleInputRows(("v",), rows, SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))
    assert list(found) == [Row(value="v", artifact_id=7, first_artifact=3, n_before=1)]
    assert calls == ["get", 6007, (3, 2, 6007)]


def test_batches_are_written_by_all_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "new_path", lambda *_: f"file://{tmp_path}/s")
    rows = spark.range(0, 1000, 1, 8).select("id")
    found = registry._in_batches(spark, rows, 3, rows.limit(0), lambda r: r)
    assert sorted(r.id for r in found.collect()) == list(range(1000))
    assert len(list(tmp_path.glob("s/in/*.parquet"))) >= 8
    assert len(list(tmp_path.glob("s/checkpoint/commits/[0-9]"))) == 2


def test_rows_of_a_stream_are_written_where_they_are(spark, tmp_path, monkeypatch):
    """No shuffle before the stream: a file has rows of one partition, and two batches take all files."""
    monkeypatch.setattr(registry, "new_path", lambda *_: f"file://{tmp_path}/s")
    rows = spark.range(0, 1000, 1, 8).select("id")
    found = registry._in_batches(spark, rows, 3, spark.range(5000, 5001).select("id"), lambda r: r)
    assert sorted(r.id for r in found.collect()) == [*range(1000), 5000]
    read = spark.read.parquet(f"file://{tmp_path}/s/in").withColumn("file", F.input_file_name()).where("id < 1000")
    assert read.groupBy("file").agg(F.countDistinct((F.col("id") / 125).cast("int")).alias("n")).where("n > 1").count() == 0
    assert len(list(tmp_path.glob("s/checkpoint/commits/[0-9]"))) == 2


def test_held_texts_are_deflated(spark):
    found = state._deflated(state.pa.array(["text " * 100, "", None, "ä\x00"])).to_pylist()
    assert len(found[0]) < 50 and [state._inflated(x) for x in found] == ["text " * 100, "", None, "ä\x00"]
