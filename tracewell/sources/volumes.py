"""File-system volumes: FAT12, FAT16 and FAT32 entries, deleted ones included, and free space as byte ranges.

The driver walks the metadata, which is small; what it finds becomes DataFrames of entries and of extents, and the bytes
of the extents are read by tasks, an extent row at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import latin

ENTRY = "name string, size bigint, deleted boolean, note string, extents array<struct<start:bigint,len:bigint>>"
Read = Callable[[int, int], bytes]


@dataclass
class Entry:
    name: str
    size: int
    deleted: bool
    note: str = ""
    extents: list[tuple[int, int]] = field(default_factory=list)


class FatVolume:
    """A volume at byte `base` of an image; read(offset, n) gives bytes of the image."""

    def __init__(self, read: Read, base: int = 0):
        boot = read(base, 512)
        u = lambda a, n: int.from_bytes(boot[a : a + n], "little")
        width, per, reserved, copies = u(11, 2), u(13, 1), u(14, 2), u(16, 1)
        if len(boot) < 512 or boot[510:] != b"\x55\xaa" or width not in (512, 1024, 2048, 4096) or not per or per & (per - 1) or not reserved or not 1 <= copies <= 4:
            raise ValueError("no FAT volume")
        roots, total, table = u(17, 2), u(19, 2) or u(32, 4), u(22, 2) or u(36, 4)
        root_bytes = -(-roots * 32 // width) * width
        self.read, self.cluster = read, width * per
        self.root = base + (reserved + copies * table) * width
        self.first = self.root + root_bytes
        self.count = (base + total * width - self.first) // self.cluster
        if not table or self.count <= 0:
            raise ValueError("no FAT volume")
        self.bits = 12 if self.count < 4085 else 16 if self.count < 65525 else 32
        self.table = read(base + reserved * width, table * width)
        self.root_bytes, self.root_cluster = root_bytes, u(44, 4) if self.bits == 32 else 0

    def next(self, n: int) -> int:
        if self.bits == 12:
            pair = int.from_bytes(self.table[n * 3 // 2 : n * 3 // 2 + 2], "little")
            return pair >> 4 if n & 1 else pair & 0xFFF
        step = self.bits // 8
        return int.from_bytes(self.table[n * step : (n + 1) * step], "little") & 0x0FFFFFFF

    def chain(self, n: int) -> list[int]:
        """Clusters from n to the end mark; a loop or a bad link ends it."""
        out, seen = [], set()
        while 2 <= n < self.count + 2 and n not in seen:
            seen.add(n)
            out.append(n)
            n = self.next(n)
        return out

    def place(self, n: int) -> int:
        return self.first + (n - 2) * self.cluster

    def _extents(self, clusters: list[int], size: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for n in clusters:
            take = min(self.cluster, size)
            if take <= 0:
                break
            if out and sum(out[-1]) == self.place(n):
                out[-1] = (out[-1][0], out[-1][1] + take)
            else:
                out.append((self.place(n), take))
            size -= take
        return out

    def entries(self) -> Iterator[Entry]:
        """All files and folders, breadth first. A deleted file's chain is gone, so its clusters are taken in a row."""
        body = self.read(self.root, self.root_bytes) if self.root_bytes else b"".join(self.read(self.place(n), self.cluster) for n in self.chain(self.root_cluster))
        folders, done = [("", body)], set()
        while folders:
            path, body = folders.pop(0)
            long: list[bytes] = []
            for a in range(0, len(body) - 31, 32):
                e = body[a : a + 32]
                if not e[0]:
                    break
                deleted = e[0] == 0xE5
                if e[11] & 0x3F == 0x0F:
                    long.append(e[1:11] + e[14:26] + e[28:32])
                    continue
                parts, long = long, []
                if e[11] & 8 or e[:2] in (b". ", b".."):
                    continue
                name = b"".join(reversed(parts)).decode("utf-16-le", "replace").split("\0")[0].rstrip("￿")
                if not name:
                    stem, ext = ((b"_" if deleted else e[:1]) + e[1:8]).decode("latin-1").rstrip(), e[8:11].decode("latin-1").rstrip()
                    name = f"{stem}.{ext}" if ext else stem
                start, size = int.from_bytes(e[26:28], "little") | (int.from_bytes(e[20:22], "little") << 16 if self.bits == 32 else 0), int.from_bytes(e[28:32], "little")
                if e[11] & 16:
                    clusters = [start] if deleted and 2 <= start < self.count + 2 else self.chain(start)
                    if start not in done and clusters:
                        done.add(start)
                        folders.append((f"{path}{name}/", b"".join(self.read(self.place(n), self.cluster) for n in clusters)))
                    continue
                need = -(-size // self.cluster)
                clusters = [n for n in range(start, start + need) if n < self.count + 2] if deleted and start >= 2 else self.chain(start)
                yield Entry(path + name, size, deleted, "clusters in a row" if deleted and size else "", self._extents(clusters, size))

    def free(self) -> list[tuple[int, int]]:
        """Byte ranges of free clusters, runs joined."""
        return self._extents([n for n in range(2, self.count + 2) if not self.next(n)], self.cluster * self.count)


def file_reader(path: str) -> Read:
    def read(offset: int, n: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(n)

    return read


def range_windows(spark: SparkSession, path: str, ranges: list[tuple[int, int]], overlap: int = 2048, step: int = 1 << 20) -> DataFrame:
    """(target, range_ix, win_offset, base, data, raw) windows over byte ranges; a window never reaches into another range,
    so nothing is found across two. A range is a row; its windows are exploded by tasks."""
    table = spark.createDataFrame([(ix, start, start + n) for ix, (start, n) in enumerate(ranges)], "range_ix int, start bigint, stop bigint").where("stop > start")
    table = table.withColumn("a", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(step).cast("bigint")))).withColumn("b", F.least(F.col("a") + step, "stop"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = file_reader(path)
        for batch in batches:
            for r in batch.to_pylist():
                begin = max(r["start"], r["a"] - overlap)
                cols = [pa.array([path]), pa.array([r["range_ix"]], pa.int32()), pa.array([begin]), pa.array([r["a"]]), pa.array([read(begin, r["b"] - begin)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["target", "range_ix", "win_offset", "base", "data"])

    spread = table.repartition(spark.sparkContext.defaultParallelism)  # rows of numbers only
    return spread.mapInArrow(load, "target string, range_ix int, win_offset bigint, base bigint, data binary").withColumn("raw", latin(F.col("data")))


def _hits(windows: DataFrame, keys: list[str], needles: list[str]) -> DataFrame:
    """Literal hits that end in a window's new bytes, with the windows' keys."""
    from ..operators.literals import literal_hits

    keyed = windows.withColumn("target", F.struct(*keys, "win_offset", "base"))
    hits = literal_hits(keyed, needles).select("target.*", "needle", "match_length", F.col("offset").alias("within"))
    return hits.select(*keys, "needle", (F.col("within") + F.col("win_offset")).alias("offset"), "match_length", "base").where("offset + match_length > base").drop("base")


def deleted_hits(spark: SparkSession, path: str, needles: list[str], base: int | None = None) -> DataFrame:
    """Literal hits in deleted files of any volume, with file_name taken from the range that holds them, by its number."""
    from .filesystems import deleted_windows

    windows, owners = deleted_windows(spark, path, base)
    return _hits(windows, ["target", "range_ix"], needles).join(owners, "range_ix").select("target", "needle", "offset", "match_length", "file_name")


def free_hits(spark: SparkSession, path: str, needles: list[str], base: int | None = None) -> DataFrame:
    """Literal hits in free space of any volume."""
    from .filesystems import free_windows

    return _hits(free_windows(spark, path, base), ["target"], needles)
