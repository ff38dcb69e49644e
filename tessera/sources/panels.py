"""Panels made from the warehouse tables, with a treatment assigned by arithmetic on the keys.

Unit k is treated iff k % 3 = 1, from period rank 10 + k % 5 on (ranks over the panel's periods); with reversals
treatment ends six periods later for even k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PANELS = ("nation_quarter", "user_day", "supplier_month", "nation_month", "supplier_quarter")


def outcome(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(unit, time, y): the panel's outcome cells, thousands where money is summed."""

    def read(table: str, *columns: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)

    if name in ("nation_quarter", "nation_month"):
        grain = "quarter" if name.endswith("quarter") else "month"
        orders = read("orders", "o_custkey", "o_orderdate", "o_totalprice").join(read("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        return orders.groupBy(F.col("c_nationkey").cast("long").alias("unit"), F.date_trunc(grain, "o_orderdate").cast("date").alias("time")).agg((F.avg("o_totalprice") / 1000).alias("y"))
    if name in ("supplier_month", "supplier_quarter"):
        grain = "quarter" if name.endswith("quarter") else "month"
        return read("lineitem", "l_suppkey", "l_shipdate", "l_extendedprice").groupBy(F.col("l_suppkey").alias("unit"), F.date_trunc(grain, "l_shipdate").cast("date").alias("time")).agg((F.sum("l_extendedprice") / 1000).alias("y"))
    if name == "user_day":
        return read("events", "user_id", "ts", "value").groupBy(F.col("user_id").alias("unit"), F.date_trunc("day", "ts").cast("date").alias("time")).agg(F.sum("value").alias("y"))
    raise ValueError(f"no such panel: {name}; there are {PANELS}")


def treated(unit: Column, rank: Column, reversals: bool = False) -> Column:
    on = (unit % 3 == 1) & (rank >= 10 + unit % 5)
    if reversals:
        on = on & ~((unit % 2 == 0) & (rank >= 16 + unit % 5))
    return on.cast("int")


def panel(spark: SparkSession, sf_dir: str, name: str, reversals: bool = False, effect: float = 0.0) -> DataFrame:
    """(unit, time, y, d, x1, region): an observed panel with treatment, a covariate and a group of units."""
    rows = outcome(spark, sf_dir, name)
    # the ranks are over the distinct periods, a table of as many rows as there are periods
    ranks = rows.select("time").distinct().withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("time")))
    rows = rows.join(ranks, "time")
    d = treated(F.col("unit"), F.col("rank"), reversals)
    x1 = ((F.col("unit") * 7 + F.col("rank") * 13 + F.col("unit") * F.col("rank")) % 11).cast("double") / 10
    return rows.select("unit", "time", (F.col("y") + F.lit(effect) * d).alias("y"), d.alias("d"), x1.alias("x1"), (F.col("unit") % 4).cast("string").alias("region"))


def uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier-month panel with what real panels have: missing and infinite outcomes, weights (some zero) and units that
    are treated throughout."""
    rows = outcome(spark, sf_dir, "supplier_month")
    ranks = rows.select("time").distinct().withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("time")))
    rows = rows.join(ranks, "time")
    unit, rank = F.col("unit"), F.col("rank")
    y = F.when((unit * 3 + rank) % 17 == 0, F.lit(None)).when((unit * 5 + rank) % 29 == 0, F.lit(float("inf"))).otherwise(F.col("y"))
    d = F.when(unit % 20 == 3, 1).otherwise(treated(unit, rank, True))
    w = F.when((unit + rank) % 13 == 0, 0).otherwise(1 + (unit + rank) % 4).cast("double")
    return rows.select("unit", "time", y.alias("y"), d.alias("d"), w.alias("w"), (unit % 4).cast("string").alias("region"))


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier-month panel with every rule broken: repeated keys, treatments of 2, groups that change, a covariate without
    variation within units (xa) and one without variation within periods (xb)."""
    rows = outcome(spark, sf_dir, "supplier_month")
    ranks = rows.select("time").distinct().withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("time")))
    rows = rows.join(ranks, "time")
    unit, rank = F.col("unit"), F.col("rank")
    d = F.when((unit + rank) % 31 == 0, 2).otherwise(treated(unit, rank))
    rows = rows.select("unit", "time", "y", d.alias("d"), F.when(unit % 9 == 0, rank % 2).otherwise(unit % 4).cast("string").alias("region"), (unit % 5).cast("double").alias("xa"), (rank % 5).cast("double").alias("xb"))
    return rows.unionByName(rows.where("unit % 7 = 0"))
