"""Intervals and runs: merging, free runs, ownership, nearest marks, votes, first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge(spans: DataFrame, key: str = "target") -> DataFrame:
    """The union of (start, len) per key: overlapping and touching ones merge; empty ones and negative starts drop."""
    own = spans.where("len > 0 and start >= 0").select(key, "start", (F.col("start") + F.col("len")).alias("end"))
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0)
    island = own.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(key, "start", (F.col("end") - F.col("start")).alias("len"))


def free_runs(units: DataFrame, key: str, at: str) -> DataFrame:
    """Runs of consecutive free units (distinct numbers `at`) of each key: first, units."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(key).orderBy(at))
    return units.select(key, at).distinct().withColumn("island", island).groupBy(key, "island").agg(F.min(at).alias("first"), F.count("*").alias("units")).drop("island")


def owner(hits: DataFrame, owners: DataFrame, key: str = "target") -> DataFrame:
    """As-of attribution: each hit with the last owner that starts at or before its offset (null if none)."""
    left = hits.select(key, F.col("offset").alias("at"), F.lit(1).alias("side"), "needle", F.lit(None).cast(owners.schema["owner"].dataType).alias("owner"))
    right = owners.select(key, F.col("start").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("needle"), "owner")
    w = Window.partitionBy(key).orderBy("at", "side", "owner").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("owner", F.last("owner", ignorenulls=True).over(w))
    return both.where("side = 1").select(key, F.col("at").alias("offset"), "needle", "owner")


def plurality(votes: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; ties go to the one seen first."""
    n = votes.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("seen"))
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), "seen", value)
    return n.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*keys, value, "votes")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")
