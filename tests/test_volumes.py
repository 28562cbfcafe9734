"""FAT volumes built here: names, deleted files, free space, and scans of both."""

import struct

import pytest

from tracewell.plans.evidence import NEEDLES
from tracewell.sources.volumes import FatVolume, deleted_hits, free_hits


def volume(bits=16):
    clusters = 5000 if bits == 16 else 300
    table_sectors = -(-(clusters + 2) * bits // 8 // 512) + 1
    first = 1 + table_sectors + 4
    total = first + clusters
    boot = bytearray(512)
    boot[11:24] = struct.pack("<HBHBHHBH", 512, 1, 1, 1, 64, total if total < 65536 else 0, 0xF8, table_sectors)
    boot[510:] = b"\x55\xaa"
    links = [0] * (clusters + 2)
    links[0], links[1] = (1 << bits) - 8, (1 << bits) - 1
    end = (1 << bits) - 1
    links[2], links[3] = 3, end  # a live file of two clusters
    links[4] = end  # a folder
    links[5] = end
    table = bytearray(table_sectors * 512)
    for n, v in enumerate(links):
        if bits == 16:
            table[2 * n : 2 * n + 2] = struct.pack("<H", v)
        else:
            at = n * 3 // 2
            old = int.from_bytes(table[at : at + 2], "little")
            table[at : at + 2] = (old & 0x000F | v << 4 if n & 1 else old & 0xF000 | v).to_bytes(2, "little")

    def entry(name, kind, start, size):
        return name + bytes([kind]) + bytes(14) + struct.pack("<HI", start, size)

    long = "deleted long.bin".encode("utf-16-le").ljust(52, b"\xff")
    parts = [b"\xe5" + long[26 * k : 26 * k + 10] + b"\x0f\0\0" + long[26 * k + 10 : 26 * k + 22] + b"\0\0" + long[26 * k + 22 : 26 * k + 26] for k in (1, 0)]
    root = entry(b"LIVE    TXT", 32, 2, 600) + b"".join(parts) + entry(b"\xe5ELETE~1BIN", 32, 8, 1000) + entry(b"SUB        ", 16, 4, 0)
    out = bytearray(boot + table + root.ljust(2048, b"\0") + bytes(clusters * 512))

    def put(cluster, data):
        at = (first + cluster - 2) * 512
        out[at : at + len(data)] = data

    put(2, b"wallet.dat live".ljust(600, b"."))
    put(4, entry(b"INNER   DAT", 32, 5, 9))
    put(5, b"crypted_k")
    put(8, b"x" * 507 + b"bestblock" + b"y" * 400)
    put(20, b"hdseed in free space")
    return bytes(out), first * 512


@pytest.mark.parametrize("bits", [12, 16])
def test_entries_and_free_space(bits):
    image, data = volume(bits)
    own = FatVolume(lambda o, n: image[o : o + n])
    got = {e.name: e for e in own.entries()}
    assert own.bits == bits and set(got) == {"LIVE.TXT", "deleted long.bin", "SUB/INNER.DAT"}
    assert got["LIVE.TXT"].extents == [(data, 600)] and not got["LIVE.TXT"].deleted
    assert got["deleted long.bin"].extents == [(data + 6 * 512, 1000)] and got["deleted long.bin"].deleted
    assert own.free()[0][0] == data + 4 * 512 and sum(n for _, n in own.free()) == (own.count - 4) * 512
    with pytest.raises(ValueError):
        FatVolume(lambda o, n: bytes(n))


def test_scans(spark, tmp_path):
    image, data = volume()
    path = tmp_path / "v.img"
    path.write_bytes(image)
    assert [(r.needle, r.offset, r.file_name) for r in deleted_hits(spark, str(path), NEEDLES).collect()] == [("bestblock", data + 6 * 512 + 507, "deleted long.bin")]
    assert {(r.needle, r.offset) for r in free_hits(spark, str(path), NEEDLES).collect()} == {("bestblock", data + 6 * 512 + 507), ("hdseed", data + 18 * 512)}
