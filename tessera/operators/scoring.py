"""Weights of event times for scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def period_weights(cells: DataFrame, proportion: float = 0.3) -> DataFrame:
    """(event_time, weight) for event times up to 0: the number of observed cells against the mean; those with less than
    ``proportion`` of the largest number weigh nothing. One row an event time, so the window is small."""
    counts = cells.where("t_on <= 0 and i_obs = 1").groupBy(F.col("t_on").alias("event_time")).agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy(F.lit(1))
    kept = counts.withColumn("n", F.when(F.col("n") >= proportion * F.max("n").over(everything), F.col("n")).otherwise(0))
    return kept.withColumn("weight", F.col("n") / F.avg(F.when(F.col("n") > 0, F.col("n"))).over(everything)).select("event_time", "weight")
