"""The usage log as a stream: calls are totalled as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flow import COUNTERS, USAGE


def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming DataFrame of counters per model over JSON lines (model, and the event) in folder."""
    lines = spark.readStream.schema(f"model string, {USAGE}").json(folder)
    done = lines.where("type = 'turn.completed'")
    return done.groupBy("model").agg(*[F.sum(F.coalesce(F.col(f"usage.{c}"), F.lit(0))).alias(c) for c in COUNTERS])
