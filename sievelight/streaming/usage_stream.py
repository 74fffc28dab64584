"""The usage log as a stream: an extension, the batch summaries are in operators.usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_usage_stream(spark: SparkSession, path: str) -> DataFrame:
    """Usage rows with their event time `at`, as files arrive."""
    return spark.readStream.schema(schemas.USAGE).option("mode", "DROPMALFORMED").json(path).withColumn("at", F.to_timestamp("time"))


def windowed_latency(usage: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Queries and mean latency per caller and window; rows later than the watermark are dropped, so
    the state is bounded by the windows still open."""
    return (
        usage.where("coalesce(queried, true)")
        .withWatermark("at", late)
        .groupBy(F.window("at", width), F.coalesce("caller", F.lit("unknown")).alias("caller"))
        .agg(F.count(F.lit(1)).alias("count"), F.avg("latencyMs").alias("mean_ms"))
        .select(F.col("window.start").alias("start"), "caller", "count", "mean_ms")
    )
