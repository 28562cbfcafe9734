"""Continuous scans: a stream of landed files through the same detectors, exactly once into a table of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import latin
from ..operators.literals import describe, literal_hits
from ..plans.evidence import NEEDLES

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    rows = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return rows.select(F.col("path").alias("target"), F.col("content").alias("data"), latin(F.col("content")).alias("raw"), "modificationTime", "length")


def scan_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, needles: list[str] = NEEDLES, **trigger: object) -> StreamingQuery:
    """Appends the hits of new files to out (Parquet); the file sink's log and the checkpoint make it exactly once."""
    hits = describe(literal_hits(file_stream(spark, folder), needles))
    return hits.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def manifest(sources: DataFrame) -> DataFrame:
    """What a resumed scan trusts: path, length and digest of what was read."""
    return sources.select("target", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256"))


def unfinished(sources: DataFrame, done: DataFrame) -> DataFrame:
    """Sources that the manifest doesn't prove: new, changed or of another size."""
    keyed = sources.withColumn("size", F.octet_length("data").cast("bigint")).withColumn("sha256", F.sha2("data", 256))
    return keyed.join(done.select("target", "size", "sha256"), ["target", "size", "sha256"], "left_anti")
