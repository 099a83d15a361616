"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.registry import registry
from treeline.streaming import streams


@registry.add("r02_stream_rows", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE value > 10 GROUP BY ALL")
def r02_stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read and filtered as a stream, bounded memory, then summed."""
    kept = streams.drain(streams.events(spark, sf_dir).where("value > 10").select("event_id", "event_type", "value"), streams.shared_folder(spark, "rows"))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@registry.add("r08_restart", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def r08_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream stopped and started again from its checkpoint reads nothing twice."""
    folder = streams.shared_folder(spark, "restart")
    stream = streams.events(spark, sf_dir).select("event_id")
    streams.drain(stream, folder)
    return streams.drain(stream, folder).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@registry.add("r06_stream_deltas", "SELECT conv_id, count(*) AS n, string_agg(text, '' ORDER BY turn) AS content FROM conversations GROUP BY ALL")
def r06_stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response pieces accumulated in keyed state."""
    pieces = streams.events(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return streams.drain_latest(streams.accumulate(pieces, "conv_id", "turn", "text"), streams.shared_folder(spark, "deltas"), "conv_id", "n")
