"""Byte sources as DataFrames: whole files, byte ranges of large files, target lists, split images, detections."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..functions.scalars import latin
from ..model import BLOCK, DETECTION, OVERLAP


def whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(target, data, raw, size) of each file under path; for files of a size that one row can hold."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return rows.select(F.col("path").alias("target"), F.col("content").alias("data"), latin(F.col("content")).alias("raw"), F.col("length").alias("size"))


def target_list(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a list file: blank lines and those that begin with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("target")).where("target <> '' and not target like '#%'")


def segment_order(files: DataFrame) -> DataFrame:
    """Segments base.001, base.002 ... of split images, up to the first gap: (image, n, target, start, size)."""
    n = F.regexp_extract("target", r"\.([0-9]{3,})$", 1)
    rows = files.where(n != "").select(F.regexp_replace("target", r"\.[0-9]{3,}$", "").alias("image"), n.cast("int").alias("n"), "target", "size")
    w = Window.partitionBy("image").orderBy("n")
    rows = rows.withColumn("nth", F.row_number().over(w)).where("nth = n")
    return rows.withColumn("start", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("nth")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Detections of JSON lines; any malformed line is an error."""
    return spark.read.schema(DETECTION).option("mode", "FAILFAST").json(path)


def write_hits(hits: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line; nulls, and by their columns' own rule zeros and empty lists, are left out."""
    lists = [c for c, t in hits.dtypes if t.startswith("array")]
    out = hits.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in lists}) if lists else hits
    if "line" in out.columns:
        out = out.withColumn("line", F.nullif(F.col("line"), F.lit(0)))
    out.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode(mode).text(path)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        import os

        self.paths = [p for p in options["path"].split(",") if p]
        self.size = {p: os.path.getsize(p) for p in self.paths}
        self.first, self.run = int(options.get("start", 0)), int(options.get("bytes", 64 << 20)) // BLOCK * BLOCK or BLOCK

    def partitions(self) -> list[_Range]:
        return [_Range(p, a, min(a + self.run, self.size[p])) for p in self.paths for a in range(self.first, self.size[p], self.run)]

    def read(self, part: _Range) -> Iterator[tuple]:
        """Windows of 1 MiB with the overlap before them; `base` is where new bytes begin."""
        step = 256 * BLOCK
        with open(part.path, "rb") as f:
            for a in range(part.start, part.end, step):
                begin = max(self.first, a - OVERLAP)
                f.seek(begin)
                yield part.path, begin, a, f.read(min(a + step, part.end) - begin)


class ByteRanges(DataSource):
    """Format "byteranges": (target, win_offset, base, data) windows of local or mounted files, a task a byte range, so
    that one large image is read by many tasks. Options: path (comma-separated), start, bytes (a task's range)."""

    @classmethod
    def name(cls) -> str:
        return "byteranges"

    def schema(self) -> str:
        return "target string, win_offset bigint, base bigint, data binary"

    def reader(self, schema: object) -> DataSourceReader:
        return _RangeReader(dict(self.options))


def byte_ranges(spark: SparkSession, *paths: str, start: int = 0, size: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    rows = spark.read.format("byteranges").option("path", ",".join(paths)).option("start", start).option("bytes", size).load()
    return rows.withColumn("raw", latin(F.col("data")))


def window_hits(windows: DataFrame, needles: list[str], start_offset: int = 0) -> DataFrame:
    """Literal hits over windows: a hit counts in the window in whose new bytes it ends, so each counts once."""
    from ..operators.literals import literal_hits, with_block

    keyed = windows.withColumn("target", F.struct("target", "win_offset", "base"))
    rows = literal_hits(keyed, needles).select(F.col("target.target").alias("target"), "needle", (F.col("offset") + F.col("target.win_offset")).alias("offset"), "match_length", F.col("target.base").alias("base"))
    return with_block(rows.where("offset + match_length > base"), start_offset)


def exit_code(hits: int, fail_on_hit: bool, covered: bool) -> int:
    """0 fine, 1 nothing was covered, 3 hits with fail_on_hit."""
    return 1 if not covered else 3 if fail_on_hit and hits else 0

