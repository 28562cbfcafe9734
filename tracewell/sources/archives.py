"""Archives: zip and gzip members become sources of their own, to a bounded depth, with skips reported as rows."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH, MEMBER = 8, 1 << 30
SCHEMA = "target string, parent string, kind string, depth int, data binary, skipped string"
_ANCHORS = (b"PK\x03\x04", b"PK\x05\x06", b"\x1f\x8b\x08")


def _places(data: bytes, mark: bytes) -> Iterator[int]:
    at = data.find(mark)
    while at >= 0:
        yield at
        at = data.find(mark, at + 1)


def _inflated(view: memoryview, most: int, window: int, step: int = 1 << 16) -> tuple[bytes, int | None, bool]:
    """(bytes, length of what was read if the stream ends well, whether there are more than `most`), reading in steps, so
    that nothing of what follows the stream is copied. A damaged stream is read again in short steps, up to the damage."""
    inflater, out, at = zlib.decompressobj(window), bytearray(), 0
    try:
        while at < len(view) and not inflater.eof:
            part = inflater.unconsumed_tail
            if not part:
                part = view[at : at + step]
                at += len(part)
            out += inflater.decompress(part, most + 1 - len(out))
            if len(out) > most:
                return b"", None, True
    except zlib.error:
        if step > 16:
            return _inflated(view, most, window, 16)
    return bytes(out), at - len(inflater.unused_data) if inflater.eof else None, False


def gzip_members(data: bytes, most: int = MEMBER) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, bytes, reason) of gzip members at any offset: method 8, no reserved flags, and at least a byte inflates.
    A damaged member gives what inflates before the damage."""
    view, end = memoryview(data), 0
    for at in _places(data, _ANCHORS[2]):
        if at >= end and at + 10 <= len(data) and not data[at + 3] & 0xE0:
            out, size, over = _inflated(view[at:], most, 31)
            if out or over:
                yield at, None if over else out, "larger than the member limit" if over else None
            end = at + size if size is not None else end


def zip_archives(data: bytes) -> Iterator[tuple[int, int]]:
    """[start, end) of the archive of every end record whose directory lies where the record says."""
    for at in _places(data, _ANCHORS[1]):
        if at + 22 <= len(data):
            directory, offset, comment = struct.unpack_from("<IIH", data, at + 12)
            start, end = at - directory - offset, at + 22 + comment
            if start >= 0 and end <= len(data):
                yield start, end


def zip_members(data: bytes, most: int = MEMBER) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, bytes, reason) of the members of every intact archive in data, and of local entries that none of them covers.
    Names are those of the members; of archives that don't start where data does, with the start before them."""
    claimed: list[tuple[int, int]] = []
    for start, end in zip_archives(data):
        lead = f"@{start}/" if start else ""
        try:
            with zipfile.ZipFile(io.BytesIO(memoryview(data)[start:end])) as z:
                claimed.append((start, end))
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    if info.file_size > most or info.flag_bits & 1:
                        yield lead + info.filename, None, "encrypted" if info.flag_bits & 1 else "larger than the member limit"
                        continue
                    try:
                        yield lead + info.filename, z.read(info), None
                    except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, OSError) as e:
                        yield lead + info.filename, None, str(e)[:100]
        except (zipfile.BadZipFile, ValueError, struct.error):
            continue
    yield from local_entries(data, claimed, most)


def local_entries(data: bytes, claimed: list[tuple[int, int]], most: int = MEMBER) -> Iterator[tuple[str, bytes, None]]:
    """(name, bytes, None) of entries known from their local header alone, outside the claimed ranges. An entry that is
    recovered claims its bytes: what lies inside it isn't an entry of its own."""
    claimed = list(claimed)
    for at in _places(data, _ANCHORS[0]):
        if at + 30 > len(data):
            break
        version, flags, method, packed, size, names, extra = struct.unpack_from("<BxHH8xIIHH", data, at + 4)
        body = at + 30 + names + extra
        readable = version <= 63 and not flags & 9 and 0 < names <= 4096 and 0 < packed < 0xFFFFFFFF and size <= most and body + packed <= len(data)
        if not readable or method not in (0, 8) or (packed != size if method == 0 else size == 0):
            continue
        if any(a <= body and body + packed <= b for a, b in claimed):
            continue
        raw = memoryview(data)[body : body + packed]
        out = bytes(raw) if method == 0 else _inflated(raw, most, -15)[0]
        claimed.append((body, body + packed))
        if out:
            yield (f"@{at}/" if at else "") + data[at + 30 : at + 30 + names].decode("utf-8", "replace")[:256], out, None


def _all_levels(depth: int, most: int, room: int = 16 << 20):
    """Every source's members at all levels, depth first, so that no level is read twice and only one branch is held."""

    def found(target: str, data: bytes, level: int) -> Iterator[tuple]:
        if not any(x in data for x in _ANCHORS):
            return
        members = [(f"{target}!{name}", "zip", out, why) for name, out, why in zip_members(data, most)] if b"PK" in data else []
        members += [(f"{target}!gzip@{at}", "gzip", out, why) for at, out, why in gzip_members(data, most)]
        while members:
            name, kind, out, why = members.pop(0)
            yield name, target, kind, level, out, why
            if out is not None and level < depth:
                yield from found(name, out, level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["target", "parent", "kind", "depth", "data", "skipped"])
        rows, held = [], 0
        for batch in batches:
            for target, data in zip(batch.column("target").to_pylist(), batch.column("data").to_pylist()):
                for row in found(target, data or b"", 1):
                    rows.append(row)
                    held += 200 + len(row[4] or b"")
                    if held >= room:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)

    return run


def expand(sources: DataFrame, depth: int = DEPTH, most: int = MEMBER) -> DataFrame:
    """(target, parent, kind, depth, data, skipped) of all members at all levels, at most `depth` deep. A member over the
    limit, or unreadable, is a row with a reason and no data: a scan with such rows isn't complete. The native anchor
    test keeps sources without archives out of Python; a source is read once, whatever the depth."""
    anchored = sources.where(F.expr("contains(data, X'504B0304') or contains(data, X'504B0506') or contains(data, X'1F8B08')"))
    return anchored.select("target", "data").mapInArrow(_all_levels(min(depth, DEPTH), most), SCHEMA)


class Sliced(Protocol):
    """Bytes that are read where they are sliced, with plain bounds."""

    def __len__(self) -> int: ...

    def __getitem__(self, part: slice) -> bytes: ...


def partitions(image: bytes | Sliced, size: int | None = None) -> list[tuple[str, int, int, int, str]]:
    """(scheme, index, start, size, type) of an MBR with its extended chain (64 links at most) or of a GPT whose
    checksums hold (4,096 entries at most). Refuses hybrid and damaged layouts."""
    size = len(image) if size is None else size
    if image[510:512] != b"\x55\xaa":
        raise ValueError("no partition table")
    u = lambda b, a, n: int.from_bytes(b[a : a + n], "little")

    def entries(sector: int) -> list[tuple[int, int, int]]:
        table = image[sector * 512 : sector * 512 + 512]
        return [(table[a + 4], u(table, a + 8, 4), u(table, a + 12, 4)) for a in range(446, 510, 16)] if len(table) == 512 and table[510:] == b"\x55\xaa" else []

    first = [e for e in entries(0) if e[0]]
    if any(e[0] == 0xEE for e in first):
        if len(first) > 1:
            raise ValueError("hybrid table")
        head = image[512:1024]
        width, count, at = u(head, 84, 4), u(head, 80, 4), u(head, 72, 8) * 512
        if head[:8] != b"EFI PART" or count > 4096 or width < 128 or zlib.crc32(head[:16] + b"\0\0\0\0" + head[20 : u(head, 12, 4)]) != u(head, 16, 4):
            raise ValueError("damaged GPT header")
        table = image[at : at + count * width]
        if zlib.crc32(table) != u(head, 88, 4):
            raise ValueError("damaged GPT entries")
        rows = [(n, table[n * width : (n + 1) * width]) for n in range(count)]
        return [("gpt", n, u(e, 32, 8) * 512, (u(e, 40, 8) - u(e, 32, 8) + 1) * 512, e[:16].hex()) for n, e in rows if any(e[:16])]
    out = [("mbr", n, s * 512, c * 512, f"{k:02x}") for n, (k, s, c) in enumerate(entries(0)) if k and k not in (5, 15, 0x85)]
    for _, base, _ in [e for e in first if e[0] in (5, 15, 0x85)]:
        link, seen = base, 0
        while link and seen < 64:
            own = entries(link)
            if not own:
                raise ValueError("damaged extended chain")
            if own[0][0]:
                out.append(("ebr", 4 + seen, (link + own[0][1]) * 512, own[0][2] * 512, f"{own[0][0]:02x}"))
            link, seen = (base + own[1][1] if own[1][0] else 0), seen + 1
    if any(a + n > size for _, _, a, n, _ in out):
        raise ValueError("a partition reaches beyond the image")
    return out
