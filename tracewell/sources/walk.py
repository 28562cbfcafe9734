"""Which files a sweep reads: directory walks with their skips, standard input, and reads that go around bad sectors."""

from __future__ import annotations

import os
import stat
import time
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import latin
from ..model import BLOCK

ATTEMPTS, PAUSE = 3, 0.05
WALKED = "path string, status string, reason string"
FILES = "target string, data binary, size bigint, skipped array<struct<start:bigint,len:bigint,reason:string>>, failed string"


def walk(root: str, follow: bool = False, depth: int = 0, own: tuple[str, ...] = ()) -> Iterator[tuple[str, str, str]]:
    """(path, status, reason) of everything under root: file, depth, own, symlink, special or failed.

    Links are skipped unless followed, when a folder is entered once; depth 0 is without limit; own are the sweep's own
    outputs (folders or files), which are never read. A root that is a link must be followed explicitly.
    """
    if os.path.islink(root) and not follow:
        raise ValueError(f"cannot sweep {root}: it is a symbolic link")
    if not os.path.lexists(root):
        raise FileNotFoundError(f"cannot sweep {root}: no such file or folder")
    root = os.path.realpath(root) if follow else os.path.abspath(root)
    mine = [os.path.abspath(x) for x in own]
    is_own = lambda p: any(p == x or p.startswith(x + os.sep) for x in mine)
    entered = {os.path.realpath(root)}
    todo = [(root, 0)]
    while todo:
        path, level = todo.pop()
        try:
            if depth and level > depth:
                yield path, "depth", f"below depth {depth}"
            elif is_own(path):
                yield path, "own", "an output of this sweep"
            elif level and os.path.islink(path):
                target = os.path.realpath(path)
                if not follow:
                    yield path, "symlink", "symbolic links aren't followed"
                elif not os.path.exists(target):
                    yield path, "failed", "broken or looped symbolic link"
                elif is_own(target):
                    yield path, "own", "an output of this sweep"
                elif not os.path.isdir(target):
                    todo.append((target, level))
                elif target in entered:
                    yield path, "failed", f"cycle: {target} was entered already"
                else:
                    entered.add(target)
                    todo.append((target, level))
            elif stat.S_ISDIR(mode := os.stat(path).st_mode):
                todo += [(os.path.join(path, name), level + 1) for name in sorted(os.listdir(path), reverse=True)]
            else:
                yield (path, "file", "") if stat.S_ISREG(mode) else (path, "special", "neither a file nor a folder")
        except OSError as e:
            yield path, "failed", str(e)


def pieces(file: BinaryIO, start: int, end: int, step: int = 256 * BLOCK, pause: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, bytes | None, str]]:
    """(offset, bytes, "") of a range in steps; what can't be read in ATTEMPTS tries is tried again by blocks, and a block
    that still can't is (offset, None, reason) and passed over. It ends where the file does."""

    def tried(at: int, n: int) -> bytes | OSError:
        for k in range(ATTEMPTS):
            if k:
                pause(k * PAUSE)
            try:
                file.seek(at)
                return file.read(n)
            except OSError as e:
                failed = e
        return failed

    for at in range(start, end, step):
        n = min(step, end - at)
        got = tried(at, n)
        if isinstance(got, bytes):
            if got:
                yield at, got, ""
            if len(got) < n:
                return
            continue
        for block in range(at, at + n, BLOCK):
            size = min(BLOCK, end - block)
            part = tried(block, size)
            if isinstance(part, bytes):
                if part:
                    yield block, part, ""
                if len(part) < size:
                    return
            else:
                yield block, None, str(part)


def read_files(files: DataFrame) -> DataFrame:
    """FILES of a table of paths (path), each read by a task: bad blocks are zeros in data and rows of skipped, so that a
    trace is never put together over a gap without being seen; a file that can't be opened, or that promises bytes and
    gives none, has failed set."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("target", pa.string()), ("data", pa.binary()), ("size", pa.int64()), ("skipped", pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int64()), ("reason", pa.string())]))), ("failed", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                data, skipped, failed, size = bytearray(), [], None, None
                try:
                    with open(path, "rb", buffering=0) as f:
                        size = os.fstat(f.fileno()).st_size
                        for at, body, why in pieces(f, 0, size):
                            if body is None:
                                n = min(BLOCK, size - at)
                                skipped.append({"start": at, "len": n, "reason": why})
                            data += body if body is not None else bytes(n)
                    if size and sum(x["len"] for x in skipped) >= len(data):
                        failed = f"covered 0 of {size} expected bytes"
                except OSError as e:
                    failed = str(e)
                yield pa.RecordBatch.from_pylist([{"target": path, "data": bytes(data), "size": size, "skipped": skipped, "failed": failed}], fields)

    return files.select("path").mapInArrow(load, FILES).withColumn("raw", latin(F.col("data")))


def sweep(spark: SparkSession, root: str, **rules: object) -> tuple[DataFrame, DataFrame]:
    """(sources, walked): the files under root as read_files gives them, and everything that the walk met (WALKED)."""
    walked = spark.createDataFrame(list(walk(root, **rules)), WALKED)
    files = walked.where("status = 'file'").repartition(spark.sparkContext.defaultParallelism)
    return read_files(files), walked


def sweep_statistics(sources: DataFrame, walked: DataFrame, hits: DataFrame) -> dict:
    """What a sweep covered: files read, files with hits, hits, bytes, skips by kind, and the first 32 failures."""
    own = sources.select("target", "size", "failed")
    total = own.agg(F.count_if(F.col("failed").isNull()).alias("files"), F.coalesce(F.sum(F.when(F.col("failed").isNull(), F.col("size"))), F.lit(0)).alias("bytes")).first()
    found = hits.agg(F.count("*").alias("hits"), F.countDistinct("target").alias("targets")).first()
    skips = {r.status: r["count"] for r in walked.where("status not in ('file', 'failed')").groupBy("status").count().collect()}
    failures = walked.where("status = 'failed'").select("path", "reason").unionAll(own.where("failed is not null").select("target", "failed"))
    return {
        "files": total.files, "bytes": total.bytes, "files_with_hits": found.targets, "hits": found.hits, "skipped": skips,
        "failed": failures.count(), "failures": [tuple(r) for r in failures.orderBy("path").limit(32).collect()],
    }


def standard_input(spark: SparkSession, stream: BinaryIO, name: str = "stdin", most: int = 1 << 30) -> DataFrame:
    """What a pipe gives, as one source; more than `most` bytes are refused, as a pipe can't be read twice."""
    data = stream.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{name} gives more than {most} bytes: write it to a file and scan that")
    rows = spark.createDataFrame([(name, bytearray(data), len(data))], "target string, data binary, size bigint")
    return rows.withColumn("raw", latin(F.col("data")))
