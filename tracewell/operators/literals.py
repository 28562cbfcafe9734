"""Literal needles under the block contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import occurrences
from ..model import BLOCK


def literal_hits(sources: DataFrame, needles: list[str], start_offset: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """target, needle, offset, block_offset, match_length of every occurrence in raw at or after start_offset.

    A narrow plan: the needles present in a source are found by a contains test, only those are located. A hit belongs
    to the block in which its last byte lies. keep: columns of sources that the rows carry on, such as raw, so that what
    is cut from around a hit is cut where the hit is found and no source is joined back; drop them in the next projection.
    """
    if any(n[k:] == n[:-k] for n in needles for k in range(1, len(n))):
        raise ValueError("a needle that overlaps itself isn't supported")
    raw = F.substr("raw", F.lit(start_offset + 1)) if start_offset else F.col("raw")
    none = F.array().cast("array<struct<needle:string,offset:bigint>>")

    def of(needle: str) -> Column:
        named = F.transform(occurrences(raw, needle), lambda at: F.struct(F.lit(needle).alias("needle"), (at + start_offset).alias("offset")))
        return F.when(raw.contains(needle), named).otherwise(none)

    found = F.concat(*map(of, needles))
    hits = sources.select("target", *keep, F.explode(found).alias("hit")).select("target", *keep, "hit.needle", "hit.offset")
    return with_block(hits.withColumn("match_length", F.length("needle")), start_offset, keep)


def with_block(hits: DataFrame, start_offset: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    at = F.expr(f"(offset + match_length - 1 - {start_offset}) div {BLOCK}") * BLOCK + start_offset
    return hits.select("target", *keep, "needle", "offset", at.cast("bigint").alias("block_offset"), F.col("match_length").cast("int").alias("match_length"))


def first_in_block(hits: DataFrame) -> DataFrame:
    """At most one report of a needle in a block, the first."""
    return hits.groupBy("target", "needle", "block_offset").agg(F.min("offset").alias("offset"), F.first("match_length").alias("match_length"))


def describe(hits: DataFrame) -> DataFrame:
    said = F.format_string("Found '%s' at %s in 4kB block at byte offset %d", "needle", "target", "block_offset")
    return hits.withColumn("description", said)
