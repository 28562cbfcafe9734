"""Carves: the bytes around a hit, what kind of file they come from, and digests of sources against a case log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import MAGICS


def carved(rows: DataFrame, context: int) -> DataFrame:
    """Adds carve: data from `context` bytes before the hit to as many after it, clamped to the source."""
    start = F.greatest(F.col("offset") - context, F.lit(0))
    return rows.withColumn("carve", F.substr("data", (start + 1).cast("int"), (F.col("offset") + F.col("match_length") + context - start).cast("int")))


def numbered(hits: DataFrame) -> DataFrame:
    """seq: the place of each hit in (target, offset, needle) order, without gathering rows in one task.

    Rows are dealt out by range and counted a partition; each partition's first number is a sum over the counts, which
    are as few as partitions.
    """
    dealt = hits.repartitionByRange("target", "offset", "needle").withColumn("part", F.spark_partition_id())
    own = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("target", "offset", "needle")))
    sizes = own.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return own.join(F.broadcast(before), "part").withColumn("seq", F.col("nth") + F.col("before")).drop("part", "nth", "before")


def _shannon(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[[9, 10, 13, *range(32, 127)]] = True


def statistics(sources: DataFrame) -> DataFrame:
    """target, size, distinct_bytes, printable_ratio, entropy_bits: one histogram a source, in the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("data"):
                n = np.bincount(np.frombuffer(data.as_py() or b"", np.uint8), minlength=256)
                total = int(n.sum())
                out.append((total, int((n > 0).sum()), round(float(n[_PRINTABLE].sum()) / total, 4) if total else 0.0, round(_shannon(n), 2) if total else 0.0))
            cols = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("target")] + [pa.array(c, t) for c, t in zip(cols, kinds)], ["target", "size", "distinct_bytes", "printable_ratio", "entropy_bits"])

    return sources.select("target", "data").mapInArrow(run, "target string, size bigint, distinct_bytes bigint, printable_ratio double, entropy_bits double")


def classes(hits: DataFrame, reach: int = 4096) -> DataFrame:
    """Adds class, magic_offset and entropy_bits of the bytes within `reach` of each hit (which carries its source's data):
    the nearest file magic (the earlier one in precedence, then in place, wins ties), else text, high-entropy or unknown."""
    rows = carved(hits, reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for offset, window in zip(batch.column("offset").to_pylist(), batch.column("carve").to_pylist()):
                start, best, kind = max(0, offset - reach), None, None
                for name, magic in MAGICS:
                    at = window.find(bytes.fromhex(magic))
                    while at >= 0:
                        if best is None or abs(start + at - offset) < abs(best - offset):
                            best, kind = start + at, name
                        at = window.find(bytes.fromhex(magic), at + 1)
                n = np.bincount(np.frombuffer(window, np.uint8), minlength=256)
                bits = _shannon(n) if window else 0.0
                if kind is None:
                    kind = "empty" if not window else "text" if n[_PRINTABLE].sum() >= 0.9 * len(window) else "high-entropy" if bits >= 7.0 else "unknown"
                out.append((kind, best, round(bits, 2)))
            cols = list(zip(*out)) or [[]] * 3
            made = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("target", "needle", "offset")] + made, ["target", "needle", "offset", "class", "magic_offset", "entropy_bits"])

    return rows.select("target", "needle", "offset", "carve").mapInArrow(run, "target string, needle string, offset bigint, class string, magic_offset bigint, entropy_bits double")


def verified(now: DataFrame, log: DataFrame) -> DataFrame:
    """target, verdict: OK, MISMATCH, NOT SCANNED (not complete), MISSING (source is gone) or NOT LOGGED."""
    both = now.select("target", "sha256").join(log, "target", "full")
    verdict = (
        F.when(F.col("logged").isNull(), F.lit("NOT LOGGED")).when(F.col("sha256").isNull(), F.lit("MISSING"))
        .when(F.col("status") != "complete", F.lit("NOT SCANNED")).when(F.col("sha256") == F.col("logged"), F.lit("OK")).otherwise(F.lit("MISMATCH"))
    )
    return both.select("target", verdict.alias("verdict"))


def covered(spans: DataFrame, want: DataFrame) -> DataFrame:
    """Proof spans that contain each wanted (target, start, len): the wanted rows that some span covers."""
    s = spans.select(F.col("target").alias("t"), F.col("start").alias("a"), (F.col("start") + F.col("len")).alias("b"))
    inside = (F.col("a") <= F.col("start")) & (F.col("start") + F.col("len") <= F.col("b"))
    return want.join(s, (F.col("target") == F.col("t")) & inside, "left_semi")
