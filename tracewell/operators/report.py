"""Triage report over detections: de-duplication, counts, spans, playbook; and the reviewed baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import PLAYBOOK, classify


def unique_hits(hits: DataFrame, order: list[Column]) -> DataFrame:
    """The first of each (target, needle, offset) in the given order."""
    w = Window.partitionBy("target", "needle", "offset").orderBy(*order)
    return hits.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def classified(hits: DataFrame) -> DataFrame:
    verified = F.col("verified") if "verified" in hits.columns else None
    return hits.withColumn("class", classify(F.col("needle"), verified)).select(*hits.columns, "class.*")


def counts(hits: DataFrame) -> DataFrame:
    """type, hits, encrypted: of unique hits."""
    return classified(hits).groupBy("type").agg(F.count("*").alias("hits"), F.count_if("encrypted").alias("encrypted"))


def totals(hits: DataFrame) -> DataFrame:
    """One row: total, unique, duplicates, targets, encrypted. Distinct keys are counted by a pre-aggregation."""
    keys = hits.groupBy("target", "needle", "offset").agg(F.count("*").alias("n"))
    own = classified(keys)
    return own.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"), F.count("*").alias("unique_hits"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
        F.countDistinct("target").alias("targets"), F.count_if("encrypted").alias("encrypted"),
    )


def spans(hits: DataFrame) -> DataFrame:
    return hits.groupBy("target").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("hits"))


def ordered(hits: DataFrame) -> DataFrame:
    return hits.orderBy("target", "offset", "needle")


def playbook(hits: DataFrame) -> DataFrame:
    """step, type, hits: the types present in the order in which to pursue them."""
    spark = hits.sparkSession
    order = spark.createDataFrame([(i + 1, t) for i, t in enumerate(PLAYBOOK)], "step int, type string")
    return counts(hits).join(F.broadcast(order), "type").select("step", "type", "hits")


def without_baseline(hits: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Hits whose fingerprint isn't reviewed; hits without one always pass. The planner picks the join by size."""
    known = reviewed.select("fingerprint").where("fingerprint is not null and fingerprint <> ''").distinct()
    keyed = hits.withColumn("key", F.when(F.col("fingerprint") != "", F.col("fingerprint")))
    return keyed.join(known.withColumnRenamed("fingerprint", "key"), "key", "left_anti").drop("key")


def steps(hits: DataFrame) -> list[str]:
    """What to pursue, in order, as words: a note on passwords first where traces are encrypted, and on lost words last
    where a phrase lacks some. There are as many types as the table of classes has."""
    found = playbook(hits).orderBy("step").collect()
    if not found:
        return ["no traces: nothing to pursue"]
    encrypted = counts(hits).agg(F.sum("encrypted")).first()[0]
    first = [f"{encrypted} encrypted traces: they need their password; look for it away from the scanned device"] if encrypted else []
    last = ["phrases that lack a word or two: scan again with the words revealed, on a machine of your own"] if not hits.where(F.col("needle").endswith("-near-miss")).isEmpty() else []
    return [*first, *(f"{r.type}: {r.hits} hits" for r in found), *last]
