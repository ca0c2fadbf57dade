"""Contents reach Python in batches bounded by bytes, whatever the number of rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from doclens.sources import artifacts


def test_batches_are_bounded(spark):
    artifacts.bounded_batches(spark)

    @F.arrow_udf("long")
    def bytes_of_batch(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    rows = spark.range(40).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    most = rows.select(bytes_of_batch("t").alias("n")).agg(F.max("n")).first()[0]
    assert most <= artifacts.BATCH_BYTES + (2 << 20)
