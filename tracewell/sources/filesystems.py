"""NTFS, ext2/3/4 and exFAT volumes, and the probe that tells which file system lies at an offset.

As with FAT (volumes.py) metadata is walked on the driver and becomes entries with extents; contents are read by tasks. A
volume offers `entries()`, deleted files included, and `free()`, its unused byte ranges. read(offset, n) gives bytes of the
image; short reads mean that the image ends there.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .archives import partitions
from .volumes import ENTRY, Entry, FatVolume, Read, file_reader, range_windows

Extents = list[tuple[int, int]]


def packed(pieces: Iterable[tuple[int, int]], size: int | None = None) -> Extents:
    """Pieces (start, length) in order, neighbours joined, cut at `size` bytes in all."""
    out: Extents = []
    for start, n in pieces:
        if size is not None:
            n = min(n, size)
            size -= n
        if n <= 0:
            continue
        if out and sum(out[-1]) == start:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((start, n))
    return out


def clear_bits(bitmap: bytes, count: int) -> list[tuple[int, int]]:
    """(first, how many) of the runs of clear bits among the first `count`, the lowest bit of a byte first."""
    bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")[:count]
    edge = np.flatnonzero(np.diff(np.concatenate([[1], bits, [1]]))).reshape(-1, 2)
    return [(int(a), int(b - a)) for a, b in edge]


@dataclass
class _Record:
    """What the records of one NTFS file say together."""

    names: list[tuple[bool, str]] = field(default_factory=list)  # long name space or not, name
    clusters: list[tuple[int, int]] = field(default_factory=list)
    inside: tuple[int, int] | None = None  # contents within the record: image offset, length
    size: int = 0
    used: bool = True
    folder: bool = False


class NtfsVolume:
    """Files are rows of the master file table; a long list of extents goes on in extension records of the same file."""

    RECORDS, GAP = 1 << 20, 128  # records at most, and unreadable ones in a row after which the table is over

    def __init__(self, read: Read, base: int = 0):
        boot = read(base, 512)
        if boot[3:11] != b"NTFS    " or len(boot) < 512:
            raise ValueError("no NTFS volume")
        width, per = struct.unpack_from("<HB", boot, 11)
        sectors, table = struct.unpack_from("<QQ", boot, 40)
        (record,) = struct.unpack_from("b", boot, 64)
        if not 512 <= width <= 4096 or not 1 <= per <= 128:
            raise ValueError("no NTFS volume")
        self.read, self.base, self.cluster, self.count = read, base, width * per, sectors // per
        self.record = 1 << -record if record < 0 else record * self.cluster
        if self.record not in (1024, 2048, 4096):
            raise ValueError("no NTFS volume")
        self.table = [(base + table * self.cluster, self.record)]
        own = self._parsed(self._raw(0) or b"", 0)
        if own and own[1].clusters:
            self.table = [(self._at(c), n * self.cluster) for c, n in own[1].clusters]
        else:
            self.table = [(self.table[0][0], self.RECORDS * self.record)]

    def _at(self, cluster: int) -> int:
        return self.base + cluster * self.cluster

    def _place(self, number: int) -> int | None:
        within = number * self.record
        for start, n in self.table:
            if within < n:
                return start + within
            within -= n
        return None

    def _raw(self, number: int) -> bytes | None:
        """A record with the last two bytes of its sectors put back; where they don't fit it is left as it is."""
        at = self._place(number)
        raw = bytearray(self.read(at, self.record)) if at is not None else bytearray()
        if len(raw) < self.record or raw[:4] != b"FILE":
            return None
        first, count = struct.unpack_from("<HH", raw, 4)
        if first >= 8 and count >= 2 and first + 2 * count <= len(raw) and len(raw) % (count - 1) == 0:
            step = len(raw) // (count - 1)
            ends = range(step - 2, len(raw), step)
            if step in (512, 1024, 2048, 4096) and all(raw[e : e + 2] == raw[first : first + 2] for e in ends):
                for k, e in enumerate(ends, 1):
                    raw[e : e + 2] = raw[first + 2 * k : first + 2 * k + 2]
        return bytes(raw)

    @staticmethod
    def _runs(body: bytes) -> list[tuple[int, int]] | None:
        """(cluster, how many) of a run list; holes have no place; None if it is damaged."""
        (at,) = struct.unpack_from("<H", body, 32)
        out, place = [], 0
        while 0 < at < len(body) and body[at]:
            long, far = body[at] & 15, body[at] >> 4
            if not 1 <= long <= 8 or far > 8 or at + 1 + long + far > len(body):
                return None
            count = int.from_bytes(body[at + 1 : at + 1 + long], "little")
            if far:
                place += int.from_bytes(body[at + 1 + long : at + 1 + long + far], "little", signed=True)
                if place < 0 or count <= 0:
                    return None
                out.append((place, count))
            at += 1 + long + far
        return out

    def _parsed(self, raw: bytes, number: int) -> tuple[int, _Record] | None:
        """(number of the base record, what this record says)."""
        if len(raw) < 48:
            return None
        at, flags, used = struct.unpack_from("<HHI", raw, 20)
        if not 48 <= at < len(raw) or used > len(raw):
            return None
        base, out = int.from_bytes(raw[32:38], "little"), _Record(used=bool(flags & 1), folder=bool(flags & 2))
        while at + 8 <= used:
            kind, n = struct.unpack_from("<II", raw, at)
            if kind == 0xFFFFFFFF or n < 24 or at + n > used:
                break
            body, outside, named = raw[at : at + n], raw[at + 8], raw[at + 9]
            size, value = struct.unpack_from("<IH", body, 16)
            inner = body[value : value + size] if not outside and value + size <= n else None
            if kind == 0x30 and inner and len(inner) >= 66 and len(inner) >= 66 + 2 * inner[64] > 66:
                name = inner[66 : 66 + 2 * inner[64]].decode("utf-16-le", "replace")
                if min(name) >= " " and "\x7f" not in name:
                    out.names.append((inner[65] in (1, 3), name))
            elif kind == 0x80 and not named and outside and n >= 64 and (runs := self._runs(body)) is not None:
                out.clusters, out.size = runs, struct.unpack_from("<Q", body, 48)[0]
            elif kind == 0x80 and not named and inner is not None and (place := self._place(number)) is not None:
                out.inside, out.size = (place + at + value, size), size
            at += -(-n // 8) * 8
        return base or number, out

    def _records(self) -> Iterator[tuple[int, int, _Record]]:
        missing = 0
        for number in range(self.RECORDS):
            raw = self._raw(number)
            missing = 0 if raw else missing + 1
            if missing > self.GAP:
                return
            if raw and (found := self._parsed(raw, number)):
                yield number, *found

    def entries(self) -> Iterator[Entry]:
        """Files with a name, by their record's number; folders aren't listed."""
        files: dict[int, _Record] = {}
        for number, base, own in self._records():
            old = files.setdefault(base, own if base == number else _Record(used=own.used))
            if old is not own:
                old.clusters, old.size = old.clusters + own.clusters, max(old.size, own.size)
                if base == number:
                    old.names, old.used, old.folder, old.inside = old.names + own.names, old.used and own.used, own.folder, old.inside or own.inside
        for number, own in files.items():
            if own.names and not own.folder:
                name = max(own.names, key=lambda x: (x[0], len(x[1])))[1]
                yield Entry(name, own.size, not own.used, f"mft:{number}", packed([own.inside] if own.inside else [(self._at(c), n * self.cluster) for c, n in own.clusters]))

    def free(self) -> Extents:
        """Runs of clusters that the volume's bitmap, record 6, leaves clear."""
        found, need = self._parsed(self._raw(6) or b"", 6), -(-self.count // 8)
        bitmap = b"".join(self.read(a, n) for a, n in packed([(self._at(c), n * self.cluster) for c, n in found[1].clusters], need)) if found else b""
        if not need or len(bitmap) < need:
            raise ValueError("the volume's bitmap can't be read")
        return [(self._at(a), n * self.cluster) for a, n in clear_bits(bitmap, self.count)]


class ExtVolume:
    """Deleting a file clears its name's entry and unlinks its inode: names without contents and contents without names
    remain, which belong together only where an unlinked folder still refers to the inode."""

    def __init__(self, read: Read, base: int = 0):
        head = read(base + 1024, 1024)
        if len(head) < 1024 or head[56:58] != b"\x53\xef":
            raise ValueError("no ext volume")
        self.inodes, self.blocks = struct.unpack_from("<II", head, 0)
        shift, per_blocks, per_inodes, first, width, wide = (struct.unpack_from(f, head, a)[0] for f, a in (("<I", 24), ("<I", 32), ("<I", 40), ("<I", 84), ("<H", 88), ("<I", 96)))
        self.read, self.base, self.first = read, base, first or 11
        self.per_blocks, self.per_inodes, self.width = per_blocks, per_inodes, width
        self.block = 1024 << shift if shift < 8 else 0
        step = (struct.unpack_from("<H", head, 254)[0] if wide & 0x80 else 32)
        if self.block not in (1024, 2048, 4096) or not (self.blocks and per_blocks and per_inodes) or width not in (128, 256) or step not in (32, 64):
            raise ValueError("no ext volume")
        raw = read(base + (2048 if self.block == 1024 else self.block), step * -(-self.blocks // per_blocks))
        self.groups = []  # (block of the bitmap, block of the inode table)
        for a in range(0, len(raw) - step + 1, step):
            low, high = struct.unpack_from("<I4xI", raw, a), struct.unpack_from("<I4xI", raw, a + 32) if step == 64 else (0, 0)
            self.groups.append(tuple(x | y << 32 for x, y in zip(low, high)))
        self._seen: dict[int, tuple | None] = {}

    def _body(self, block: int) -> bytes:
        return self.read(self.base + block * self.block, self.block) if 0 <= block < self.blocks else b""

    def inode(self, number: int) -> tuple[bool, int, int, list[int]] | None:
        """(is it a folder, links, size, its blocks) of a row of the inode table; None if it is empty or can't be."""
        if number not in self._seen:
            self._seen[number] = self._inode(number)
        return self._seen[number]

    def _inode(self, number: int) -> tuple[bool, int, int, list[int]] | None:
        group, row = divmod(number - 1, self.per_inodes)
        if not 1 <= number <= self.inodes or group >= len(self.groups) or max(self.groups[group]) >= self.blocks:
            return None
        raw = self.read(self.base + self.groups[group][1] * self.block + row * self.width, self.width)
        if len(raw) < self.width or raw[:2] == b"\0\0":
            return None
        mode, low, links, flags, high = (struct.unpack_from(f, raw, a)[0] for f, a in (("<H", 0), ("<I", 4), ("<H", 26), ("<I", 32), ("<I", 108)))
        size = low | high << 32
        if size > self.blocks * self.block:
            return None
        found = self._tree(raw[40:100], 0) if flags & 0x80000 else self._pointers(raw[40:100])
        return mode & 0xF000 == 0x4000, links, size, list(found)[: -(-size // self.block)]

    def _tree(self, node: bytes, depth: int) -> Iterator[int]:
        """Blocks of an extent tree, at most four levels deep."""
        if len(node) < 12 or depth > 3:
            return
        magic, entries, level = struct.unpack_from("<HH2xH", node, 0)
        if magic != 0xF30A or entries > 340 or len(node) < 12 + 12 * entries:
            return
        for a in range(12, 12 + 12 * entries, 12):
            if level:
                low, high = struct.unpack_from("<IH", node, a + 4)
                yield from self._tree(self._body(low | high << 32), depth + 1)
            else:
                count, high, low = struct.unpack_from("<HHI", node, a + 4)
                start = low | high << 32
                yield from range(start, min(start + (count - 32768 if count > 32768 else count), self.blocks))

    def _pointers(self, raw: bytes) -> Iterator[int]:
        """Twelve direct blocks and those of the single indirect one; deeper trees seldom survive a deletion."""
        direct = struct.unpack_from("<13I", raw, 0)
        single = self._body(direct[12]) if direct[12] else b""
        for b in (*direct[:12], *struct.unpack(f"<{len(single) // 4}I", single)):
            if 0 < b < self.blocks:
                yield b

    def _names(self, block: bytes) -> Iterator[tuple[int, str]]:
        """(inode, or 0 where the entry is cleared, name) of a folder's block, and of what lingers in entries' slack."""

        def at(p: int, end: int, live: bool) -> tuple[int, str] | None:
            number, n = struct.unpack_from("<I2xB", block, p)
            name = block[p + 8 : p + 8 + n]
            if not n or p + 8 + n > end:
                return None
            plausible = all(c >= 32 and c not in (127, 47) for c in name)
            if live and number or plausible and (not number or not live and self.inode(number)):
                return number, name.decode("utf-8", "replace")
            return None

        p = 0
        while p + 8 <= len(block):
            length, n = struct.unpack_from("<HB", block, p + 4)
            if length < 8 or length % 4 or p + length > len(block):
                return
            if 0 < n <= length - 8:
                for q in (p, *range(p + (8 + n + 3) // 4 * 4, p + length - 7, 4)):
                    if found := at(q, p + length, q == p):
                        yield found
            p += length

    def entries(self) -> Iterator[Entry]:
        """Files by inode, then names whose inode is lost. A file without a name is known by its inode."""
        names: dict[int, str] = {}
        lost: dict[str, None] = {}
        done: set[int] = set()

        def walk(number: int) -> None:
            todo = [(number, 0)]
            while todo:
                folder, depth = todo.pop()
                own = self.inode(folder)
                if folder in done or depth > 32 or not own or not own[0]:
                    continue
                done.add(folder)
                for child, name in (x for b in own[3] for x in self._names(self._body(b))):
                    if not child:
                        lost.setdefault(name)
                    elif name not in (".", ".."):
                        names.setdefault(child, name)
                        todo.append((child, depth + 1))

        walk(2)
        rows = [(k, own) for k in range(self.first, self.inodes + 1) if (own := self.inode(k))]
        for k, own in rows:
            if own[0] and not own[1]:
                walk(k)
        for k, (folder, links, size, blocks) in rows:
            if not folder:
                yield Entry(names.get(k, ""), size, not links, f"inode:{k}", packed(((self.base + b * self.block, self.block) for b in blocks), size))
        for name in lost:
            yield Entry(name, 0, True, "residual dir entry")

    def free(self) -> Extents:
        """Runs of blocks that the groups' bitmaps leave clear."""
        runs = []
        for g, (bitmap, _) in enumerate(self.groups):
            own = self._body(bitmap)
            if len(own) < self.block:
                raise ValueError(f"the block bitmap of group {g} can't be read")
            first = g * self.per_blocks
            runs += [((first + a) * self.block + self.base, n * self.block) for a, n in clear_bits(own, min(self.per_blocks, self.blocks - first))]
        return packed(runs)


class ExfatVolume:
    """Entry sets of a file, a stream and names; a deleted set keeps them all, with the in-use bit off."""

    def __init__(self, read: Read, base: int = 0):
        boot = read(base, 512)
        if len(boot) < 512 or boot[0] not in (0xEB, 0xE9) or boot[3:11] != b"EXFAT   " or boot[510:] != b"\x55\xaa" or boot[108] != 9 or boot[109] > 16 or boot[110] not in (1, 2):
            raise ValueError("no exFAT volume")
        table, _, heap, self.count, self.root = struct.unpack_from("<5I", boot, 80)
        if not 0 < self.count <= 1 << 30 or not 0 < table < heap or not 2 <= self.root < self.count + 2:
            raise ValueError("no exFAT volume")
        self.read, self.cluster, self.heap = read, 512 << boot[109], base + heap * 512
        self.table = read(base + table * 512, min((heap - table) * 512, (self.count + 2) * 4))

    def _place(self, n: int) -> int:
        return self.heap + (n - 2) * self.cluster

    def _chain(self, n: int, in_a_row: bool) -> Iterator[int]:
        seen = set()
        while 2 <= n < self.count + 2 and n not in seen:
            seen.add(n)
            yield n
            n = n + 1 if in_a_row else struct.unpack_from("<I", self.table, 4 * n)[0] if 4 * n + 4 <= len(self.table) else 0

    def _folder(self, n: int, in_a_row: bool) -> list[bytes]:
        """The 32-byte entries of a folder up to its end mark."""
        out: list[bytes] = []
        for c in self._chain(n, in_a_row):
            body = self.read(self._place(c), self.cluster)
            for a in range(0, len(body) - 31, 32):
                if not body[a]:
                    return out
                out.append(body[a : a + 32])
            if len(body) < self.cluster or len(out) > 1 << 21:
                break
        return out

    def entries(self) -> Iterator[Entry]:
        todo, done = [(self.root, False, "root")], set()
        while todo:
            first, in_a_row, where = todo.pop(0)
            if first in done:
                continue
            done.add(first)
            slots, at = self._folder(first, in_a_row), 0
            while at < len(slots):
                head, more = slots[at], slots[at + 1 : at + 1 + slots[at][1]]
                if head[0] & 0x7F != 5 or not more or len(more) < head[1] or more[0][0] & 0x7F != 0x40:
                    at += 1
                    continue
                flags, length, start, size = more[0][1], more[0][3], *struct.unpack_from("<IQ", more[0], 20)
                parts = [x[2:] for x in more[1:] if x[0] & 0x7F == 0x41]
                if len(parts) * 15 >= length:
                    name, live = b"".join(parts)[: 2 * length].decode("utf-16-le", "replace"), bool(head[0] & 0x80)
                    if head[4] & 16:
                        todo += [(start, bool(flags & 2), f"clust:{start}")] if live else []
                    else:
                        yield Entry(name, size, not live, f"exfat:{where}:slot:{at}", self._extents(start, size, bool(flags & 2)))
                at += 1 + len(more)

    def _extents(self, start: int, size: int, in_a_row: bool) -> Extents:
        def pieces() -> Iterator[tuple[int, int]]:
            left = size
            for c in self._chain(start, in_a_row):
                if left <= 0:
                    return
                yield self._place(c), self.cluster
                left -= self.cluster

        return packed(pieces(), size)

    def free(self) -> Extents:
        """Runs of clusters that the allocation bitmap, named by a live entry of the root folder, leaves clear."""
        for e in self._folder(self.root, False):
            start, size = struct.unpack_from("<IQ", e, 20)
            if e[0] == 0x81 and start >= 2 and size >= -(-self.count // 8):
                bitmap = self.read(self._place(start), -(-self.count // 8))
                if len(bitmap) * 8 >= self.count:
                    return [(self._place(a + 2), n * self.cluster) for a, n in clear_bits(bitmap, self.count)]
        raise ValueError("the volume has no allocation bitmap")


KINDS = {"ntfs": NtfsVolume, "ext": ExtVolume, "fat": FatVolume, "exfat": ExfatVolume}


def open_volume(read: Read, base: int = 0) -> tuple[str, NtfsVolume | ExtVolume | FatVolume | ExfatVolume]:
    """(kind, volume) of the first kind that fits; a ValueError names the offset if none does."""
    for kind, make in KINDS.items():
        try:
            return kind, make(read, base)
        except (ValueError, struct.error):
            continue
    raise ValueError(f"no NTFS, ext, FAT or exFAT volume at offset {base}")


class _View:
    """An image as something that is sliced."""

    def __init__(self, read: Read):
        self.read = read

    def __len__(self) -> int:
        return 1 << 62

    def __getitem__(self, part: slice) -> bytes:
        return self.read(part.start, part.stop - part.start)


def volumes_of(read: Read, base: int | None = None) -> list[tuple[int, str]]:
    """(offset, kind) of the volumes to scan: the one at `base`, or without a base the one at 0, else those of the partition
    table. Where none opens the error says what was tried; nothing is guessed."""
    try:
        return [(base or 0, open_volume(read, base or 0)[0])]
    except ValueError as first:
        if base is not None:
            raise
        found, tried = [], []
        for scheme, index, start, size, kind in partitions(_View(read)):
            tried.append(f"{scheme} {index} ({kind}) at {start}, {size} bytes")
            try:
                found.append((start, open_volume(read, start)[0]))
            except ValueError:
                continue
        if not found:
            raise ValueError(f"{first}, and of its partitions none opens: {'; '.join(tried) or 'there are none'}") from None
        return found


def inventory(spark: SparkSession, path: str, base: int | None = None) -> DataFrame:
    """The entries of all volumes of an image, with the volume's offset and kind."""
    read = file_reader(path)
    rows = [(at, kind, e.name, e.size, e.deleted, e.note, e.extents) for at, kind in volumes_of(read, base) for e in open_volume(read, at)[1].entries()]
    return spark.createDataFrame(rows, f"volume bigint, kind string, {ENTRY}")


def deleted_windows(spark: SparkSession, path: str, base: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Windows over the extents of all deleted files, and (range_ix, file_name): a range is known by its number, as deleted
    files may overlap; a file without a name goes by its note."""
    read = file_reader(path)
    gone = [(x, e.name or e.note) for at, _ in volumes_of(read, base) for e in open_volume(read, at)[1].entries() if e.deleted for x in e.extents]
    owners = spark.createDataFrame([(ix, name) for ix, (_, name) in enumerate(gone)], "range_ix int, file_name string")
    return range_windows(spark, path, [x for x, _ in gone]), owners


def free_windows(spark: SparkSession, path: str, base: int | None = None) -> DataFrame:
    """Windows over the free space of all volumes."""
    read = file_reader(path)
    return range_windows(spark, path, sorted(x for at, _ in volumes_of(read, base) for x in open_volume(read, at)[1].free()))
