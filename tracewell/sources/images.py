"""Forensic images: EWF version 1 segment sets, read chunk by chunk on executors.

The driver reads section headers and chunk tables only, into a DataFrame of chunks; each task opens the segment that
holds its chunks, checks and inflates them. A damaged chunk is an error, as silence about it would look like absence.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE, CHUNK = b"EVF\x09\x0d\x0a\xff\x00", 64 << 20


@dataclass(frozen=True)
class Layout:
    """size: bytes of media; chunks: (number, segment path, offset, stored bytes, is compressed)."""

    size: int
    chunk_bytes: int
    chunks: list[tuple[int, str, int, int, bool]]


def segments(first: str) -> list[str]:
    """The consecutive segments of a set: .E01 .E02 ... .E99 .EAA ..., of any of the known first letters."""
    stem, ext = os.path.splitext(first)
    if not re.fullmatch(r"\.[ESes]01", ext):
        raise ValueError(f"{first} isn't a first segment")
    letter = ext[1]
    a = "A" if letter.isupper() else "a"
    names = [f"{letter}{n:02d}" for n in range(1, 100)]
    names += [chr(ord(letter) + k) + chr(ord(a) + x) + chr(ord(a) + y) for k in range(3) for x in range(26) for y in range(26)]
    out = []
    for name in names:
        if not os.path.exists(f"{stem}.{name}"):
            break
        out.append(f"{stem}.{name}")
    return out


def layout(first: str) -> Layout:
    size = chunk_bytes = 0
    chunks: list[tuple[int, str, int, int, bool]] = []
    for path in segments(first):
        with open(path, "rb") as f:
            if f.read(8) != SIGNATURE:
                raise ValueError(f"{path} isn't a segment of version 1")
            at, end_of_data = 13, 0
            while True:
                f.seek(at)
                head = f.read(76)
                if len(head) < 76 or zlib.adler32(head[:72]) != struct.unpack("<I", head[72:])[0]:
                    raise ValueError(f"{path}: damaged section at {at}")
                kind = head[:16].rstrip(b"\0").decode("latin-1")
                following, length = struct.unpack("<QQ", head[16:32])
                if kind in ("volume", "disk") and not chunk_bytes:
                    body = f.read(24)
                    count, per, width = struct.unpack("<III", body[4:16])
                    chunk_bytes, size = per * width, struct.unpack("<Q", body[16:24])[0] * width
                    if not 0 < chunk_bytes <= CHUNK:
                        raise ValueError(f"{path}: chunks of {chunk_bytes} bytes")
                elif kind == "sectors":
                    end_of_data = at + length
                elif kind == "table":
                    count, _, base = struct.unpack("<IIQ", f.read(16))
                    f.read(8)
                    entries = struct.unpack(f"<{count}I", f.read(4 * count))
                    places = [base + (e & 0x7FFFFFFF) for e in entries] + [end_of_data]
                    chunks += [(len(chunks) + k, path, places[k], places[k + 1] - places[k], bool(e >> 31)) for k, e in enumerate(entries)]
                if kind in ("done", "next") or following <= at:
                    break
                at = following
    if not chunk_bytes or len(chunks) * chunk_bytes < size:
        raise ValueError(f"{first}: the chunk tables don't cover the media")
    return Layout(size, chunk_bytes, chunks)


def chunk(raw: bytes, compressed: bool, size: int) -> bytes:
    """The media bytes of a stored chunk; its checksum must hold."""
    if compressed:
        out = zlib.decompressobj().decompress(raw, size + 1)
    else:
        out = raw[:size]
        if len(raw) < size + 4 or zlib.adler32(out) != struct.unpack("<I", raw[size : size + 4])[0]:
            raise ValueError("a stored chunk's checksum doesn't hold")
    if len(out) != size:
        raise ValueError(f"a chunk of {len(out)} bytes instead of {size}")
    return out


def image_windows(spark: SparkSession, first: str, overlap: int = 2048, run: int = 64) -> DataFrame:
    """(target, win_offset, base, data) windows over the media, for window_hits: a task reads runs of chunks, and each
    window brings the end of the chunk before it."""
    own = layout(first)
    rows = [(n, path, at, size, packed) for n, path, at, size, packed in own.chunks if n * own.chunk_bytes < own.size]
    before = {r[0]: r for r in rows}
    flat = [(*r, *(before[r[0] - 1][1:] if r[0] else (None, None, None, None))) for r in rows]
    table = spark.createDataFrame(flat, "n long, path string, at long, size long, packed boolean, path0 string, at0 long, size0 long, packed0 boolean")
    table = table.repartitionByRange(max(1, len(flat) // run), "n")

    def read(path: str, at: int, size: int, packed: bool, n: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(at)
            return chunk(f.read(size), packed, min(own.chunk_bytes, own.size - n * own.chunk_bytes))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lead = read(r["path0"], r["at0"], r["size0"], r["packed0"], r["n"] - 1)[-overlap:] if r["path0"] else b""
                base = r["n"] * own.chunk_bytes
                data = lead + read(r["path"], r["at"], r["size"], r["packed"], r["n"])
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([base - len(lead)]), pa.array([base]), pa.array([data], pa.binary())], ["target", "win_offset", "base", "data"])

    out = table.mapInArrow(windows, "target string, win_offset bigint, base bigint, data binary")
    return out.withColumn("raw", F.decode("data", "ISO-8859-1"))
