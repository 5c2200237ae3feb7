"""Incremental composite: new scenes arrive as files, and the pixels they touch are made anew.

The batch operators have no stream to match; this keeps their results fresh.  Each micro-batch
is written under its own id, so a batch that is run again replaces its own rows, and the median
of the touched pixels is taken over all observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.zonal import composite_pixels

SCHEMA = T.StructType([T.StructField("pixel", T.LongType()), T.StructField("scene", T.StringType()), T.StructField("dn", T.DoubleType()), T.StructField("qa", T.LongType())])


def refresh(store: str, bad_bits: list[int], gain: float, offset: float, least_looks: int):
    """A ``foreachBatch`` function."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/observations/batch={batch_id}")
        seen = spark.read.parquet(f"{store}/observations").drop("batch")
        touched = seen.join(batch.select("pixel").distinct(), "pixel", "left_semi")
        composite_pixels(touched, gain, offset, bad_bits, least_looks).withColumn("as_of", F.lit(batch_id)).write.mode("overwrite").parquet(f"{store}/composite/batch={batch_id}")

    return run


def latest(spark: SparkSession, store: str) -> DataFrame:
    """Each pixel's newest value."""
    return spark.read.parquet(f"{store}/composite").groupBy("pixel").agg(F.max_by("value", "as_of").alias("value"), F.max_by("looks", "as_of").alias("looks"))


def start(spark: SparkSession, source: str, store: str, bad_bits: list[int], gain: float, offset: float, least_looks: int):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(refresh(store, bad_bits, gain, offset, least_looks)).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
