"""Roll-ups over conversation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def operation(text: Column) -> Column:
    """What a message asks for, by its words; null if it says nothing of it."""
    t = F.lower(text)
    return F.when(t.contains("fuzz"), "fuzz").when(t.contains("stub"), "stub").when(t.contains("implement"), "implement").when(t.contains("que "), "query").when(t.contains("the "), "plain")


def classify(turns: DataFrame) -> DataFrame:
    """``conv_id, operation``: of all matching messages the last wins; ``unknown`` if none matches."""
    known = turns.withColumn("op", operation(F.col("text")))
    return known.groupBy("conv_id").agg(F.coalesce(F.max_by("op", F.when(F.col("op").isNotNull(), F.col("turn"))), F.lit("unknown")).alias("operation"))


def token_estimate(turns: DataFrame) -> DataFrame:
    """``conv_id, prompt_tokens, completion_tokens``: a quarter of the characters, at least one for completions."""
    size = lambda own: F.coalesce(F.sum(F.when((F.col("role") == "assistant") == F.lit(own), F.length("text"))), F.lit(0))
    return turns.groupBy("conv_id").agg(F.floor(size(False) / 4).alias("prompt_tokens"), F.greatest(F.floor(size(True) / 4), F.lit(1)).alias("completion_tokens"))


def costs(turns: DataFrame, prompt_price: float, completion_price: float) -> DataFrame:
    """A row per conversation with its operation, tokens and cost."""
    cost = F.round(F.col("prompt_tokens") * prompt_price + F.col("completion_tokens") * completion_price, 8)
    return classify(turns).join(token_estimate(turns), "conv_id").withColumn("cost", cost)


def rollup(rows: DataFrame, by: str) -> DataFrame:
    """Sums, counts, share of the whole and mean cost by a column; no division by zero."""
    total = rows.agg(F.sum("cost").alias("all_cost"))
    summed = rows.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.sum("cost").alias("cost"))
    return summed.crossJoin(F.broadcast(total)).select(by, "calls", "prompt", "completion", F.round("cost", 4).alias("cost"), F.round(100 * F.try_divide("cost", "all_cost"), 4).alias("share"), F.round(F.try_divide("cost", "calls"), 6).alias("mean_cost"))


def stop_turns(turns: DataFrame, rounds: int = 5) -> DataFrame:
    """``conv_id, stop_turn, rounds``: the first assistant turn without a question, within so many rounds."""
    stop = F.min(F.when((F.col("role") == "assistant") & ~F.col("text").contains("?") & (F.col("turn") < 2 * rounds), F.col("turn")))
    return turns.groupBy("conv_id").agg(stop.alias("stop_turn"), F.least(F.count_if(F.col("role") == "assistant"), F.lit(rounds)).alias("rounds"))
