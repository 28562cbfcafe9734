"""Connected components by alternating large-star and small-star, on DataFrames of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _hung(links: DataFrame, to: str) -> DataFrame:
    """Hangs neighbours on the least of each vertex's neighbourhood. to: "larger" or "smaller" neighbours.

    The minimum is aggregated before the shuffle, written, and joined back, so that a vertex with a great many links is
    spread over tasks by the join's skew handling rather than gathered.
    """
    if to == "larger":
        links = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
    both = links.join(least, "u")
    if to == "larger":
        return both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return both.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every vertex of links with the least vertex that it reaches. Null ends are left out."""
    now = written(_ordered(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")), "links")
    mark = _mark(now)
    while mark[0]:
        now = written(_ordered(_hung(_ordered(_hung(now, "larger")), "smaller")), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    named = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")))
    return written(named.distinct(), "components")
