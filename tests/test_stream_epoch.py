"""Files dated at the epoch, or before it, are not late before there is a watermark."""

from doclens.streaming import stream

SCHEMA = "artifact_id long, description string, modificationTime timestamp"


def test_dedup_keeps_the_epoch(spark, tmp_path):
    times = "VALUES (0, 0), (0, 0), (1, 1), (2, -5), (7200, 0), (3, NULL)"
    rows = spark.sql(f"SELECT CAST(a AS BIGINT) AS artifact_id, 'd' AS description, timestamp_seconds(s) AS modificationTime FROM {times} AS v(a, s)")
    rows.write.parquet(f"{tmp_path}/in")
    found = stream.dedup_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "3 hours")
    assert found.columns == rows.columns
    q = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{tmp_path}/out")
    assert sorted(r["artifact_id"] for r in out.collect()) == [0, 1, 2, 3, 7200]
    assert out.exceptAll(rows.distinct()).isEmpty()
