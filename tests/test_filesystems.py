"""NTFS, ext and exFAT volumes built here: entries, deleted files, free space, the probe and scans."""

import struct

import pytest

from tracewell.plans.evidence import NEEDLES
from tracewell.sources.filesystems import ExfatVolume, ExtVolume, NtfsVolume, clear_bits, inventory, open_volume, packed, volumes_of
from tracewell.sources.volumes import deleted_hits, free_hits


def reader(image):
    return lambda at, n: bytes(image[at : at + n])


def put(image, at, data):
    image[at : at + len(data)] = data


def bits(count, used):
    out = bytearray(-(-count // 8))
    for k in used:
        out[k >> 3] |= 1 << (k & 7)
    return bytes(out)


def attribute(kind, value=None, runs=None, size=0, name=0):
    if runs is None:
        body = struct.pack("<IHBB", len(value), 24, 0, 0) + value
        head = struct.pack("<BBHHH", 0, name, 24, 0, 0)
    else:
        body = struct.pack("<QQHHIQQQ", 0, 0, 64, 0, 0, size, size, size) + runs
        head = struct.pack("<BBHHH", 1, name, 64, 0, 0)
    whole = -(-(16 + len(body)) // 8) * 8
    return (struct.pack("<II", kind, whole) + head + body).ljust(whole, b"\0")


def called(name, space=1):
    return attribute(0x30, bytes(64) + bytes([len(name), space]) + name.encode("utf-16-le"))


def record(*attributes, flags=1, base=0):
    body = b"".join(attributes) + struct.pack("<II", 0xFFFFFFFF, 0)
    raw = bytearray((b"FILE" + struct.pack("<HHQHHHHIIQ", 48, 3, 0, 1, 1, 56, flags, 56 + len(body), 1024, base)).ljust(56, b"\0") + body).ljust(1024, b"\0")
    put(raw, 48, b"\x07\0" + raw[510:512] + raw[1022:1024])
    raw[510:512] = raw[1022:1024] = b"\x07\0"
    return bytes(raw)


def ntfs():
    image = bytearray(128 * 512)
    boot = bytearray(512)
    put(boot, 0, b"\xeb\x52\x90NTFS    " + struct.pack("<HB", 512, 1))
    put(boot, 40, struct.pack("<QQ", 128, 8))
    boot[64], boot[510], boot[511] = 0xF6, 0x55, 0xAA
    put(image, 0, boot)
    long = b"x" * 440 + b"hdseed in a record"  # crosses the first sector's end, which is fixed up
    rows = {
        0: record(called("$MFT"), attribute(0x80, runs=b"\x11\x10\x08\x11\x0c\x38\0", size=14 * 1024)),  # 16 clusters at 8, 12 at 64
        6: record(called("$Bitmap"), attribute(0x80, runs=b"\x11\x01\x32\0", size=16)),
        7: record(called("LIVE~1.TXT", 2), called("live file.txt"), attribute(0x80, long), attribute(0x80, b"stream", name=4)),
        8: record(called("gone.bin"), attribute(0x80, runs=b"\x11\x02\x28\x01\x05\x11\x01\xfe\0", size=1400), flags=0),  # 2 at 40, a hole, 1 at 38
        9: record(attribute(0x80, runs=b"\x11\x01\x2d\0", size=2000), flags=0, base=8),
        10: record(called("folder"), flags=3),
        11: record(called("small.txt"), attribute(0x80, b"tiny bestblock"), flags=0),
        12: record(attribute(0x80, b"no name"), flags=0),
    }
    for n, row in rows.items():
        put(image, (8 * 512 + n * 1024) if n < 8 else 64 * 512 + (n - 8) * 1024, row)
    put(image, 50 * 512, bits(128, [*range(0, 24), 50, *range(64, 76)]))
    put(image, 40 * 512, b"z" * 1020 + b"crypted_key")  # begins in one cluster of the file, ends in no other: lost at the edge
    put(image, 45 * 512, b"wallet.dat")
    put(image, 100 * 512, b"keymeta")
    return image


def test_ntfs():
    own = NtfsVolume(reader(ntfs()))
    got = {e.name: e for e in own.entries()}
    assert set(got) == {"$MFT", "$Bitmap", "live file.txt", "gone.bin", "small.txt"}
    live, gone = got["live file.txt"], got["gone.bin"]
    assert not live.deleted and live.size == 458 and live.note == "mft:7" and gone.deleted and gone.size == 2000
    assert gone.extents == [(40 * 512, 1024), (38 * 512, 512), (45 * 512, 512)]
    (at, n), image = got["small.txt"].extents[0], ntfs()
    assert bytes(image[at : at + n]) == b"tiny bestblock"
    assert own._raw(7)[live.extents[0][0] - 8 * 512 - 7 * 1024 :][:458].endswith(b"hdseed in a record")
    assert own.free() == [(24 * 512, 26 * 512), (51 * 512, 13 * 512), (76 * 512, 52 * 512)]


def entry(number, name, length=None):
    whole = (8 + len(name) + 3) // 4 * 4
    return (struct.pack("<IHBB", number, length or whole, len(name), 1) + name).ljust(length or whole, b"\0")


def ext():
    image = bytearray(64 * 1024)
    put(image, 1024, struct.pack("<II", 32, 64) + bytes(16) + struct.pack("<I", 0) + bytes(4) + struct.pack("<III", 8192, 0, 32))
    put(image, 1024 + 56, b"\x53\xef")
    put(image, 1024 + 84, struct.pack("<IH", 11, 128))
    put(image, 2048, struct.pack("<III", 3, 4, 5))
    put(image, 3 * 1024, bits(64, range(12)))

    def inode(number, mode, size, links, blocks, flags=0):
        body = struct.pack("<HHI", mode, 0, size) + bytes(18) + struct.pack("<HII", links, 0, flags) + bytes(4) + blocks
        put(image, 5 * 1024 + (number - 1) * 128, body.ljust(128, b"\0"))

    inode(2, 0x41ED, 1024, 2, struct.pack("<I", 9))
    inode(12, 0x81A4, 1500, 1, struct.pack("<II", 10, 11))
    inode(13, 0x81A4, 600, 0, struct.pack("<I", 12))
    leaf = struct.pack("<HHHHI", 0xF30A, 1, 4, 0, 0) + struct.pack("<IHHI", 0, 2, 0, 20)
    inode(14, 0x81A4, 1600, 0, leaf, 0x80000)
    inode(15, 0x41ED, 1024, 0, struct.pack("<I", 13))  # an unlinked folder
    inode(16, 0x81A4, 14 * 1024, 0, struct.pack("<13I", *range(30, 42), 25))
    put(image, 25 * 1024, struct.pack("<III", 42, 43, 44))
    slack = entry(13, b"gone.bin") + entry(0, b"lost.dat")
    put(image, 9 * 1024, entry(2, b".", 12) + entry(2, b"..", 12) + entry(12, b"live.txt", 1000)[:16] + slack)
    put(image, 13 * 1024, entry(15, b".", 12) + entry(2, b"..", 12) + entry(16, b"long.img", 1000))
    put(image, 12 * 1024, b"x" * 590 + b"hdseed.....")  # the file ends within
    put(image, 20 * 1024, b"acentry")
    put(image, 50 * 1024, b"defaultkey")
    return image


def test_ext():
    own = ExtVolume(reader(ext()))
    got = {(e.name or e.note): e for e in own.entries()}
    assert set(got) == {"live.txt", "gone.bin", "inode:14", "long.img", "lost.dat"}
    assert got["live.txt"].extents == [(10 * 1024, 1500)] and not got["live.txt"].deleted
    assert got["gone.bin"].extents == [(12 * 1024, 600)] and got["gone.bin"].deleted
    assert got["inode:14"].extents == [(20 * 1024, 1600)] and got["inode:14"].deleted
    assert got["long.img"].extents == [(30 * 1024, 14 * 1024)]
    assert got["lost.dat"].note == "residual dir entry" and not got["lost.dat"].extents
    assert own.free() == [(12 * 1024, 52 * 1024)]


def exfat():
    image = bytearray((8 + 40) * 512)
    boot = bytearray(512)
    put(boot, 0, b"\xeb\x76\x90EXFAT   ")
    put(boot, 80, struct.pack("<5I", 2, 1, 8, 40, 2))
    boot[108], boot[109], boot[110], boot[510], boot[511] = 9, 0, 1, 0x55, 0xAA
    put(image, 0, boot)
    links = {2: 0xFFFFFFFF, 4: 6, 6: 0xFFFFFFFF, 5: 0xFFFFFFFF}
    for n, v in links.items():
        put(image, 1024 + 4 * n, struct.pack("<I", v))

    def group(name, start, size, live=True, folder=False, in_a_row=False):
        parts = -(-len(name) // 15)
        on = 0x80 if live else 0
        out = bytes([0x05 | on, 1 + parts, 0, 0, 0x10 if folder else 0x20]).ljust(32, b"\0")
        out += (bytes([0x40 | on, 2 if in_a_row else 0, 0, len(name)]) + bytes(16) + struct.pack("<IQ", start, size)).ljust(32, b"\0")
        units = name.encode("utf-16-le").ljust(parts * 30, b"\0")
        return out + b"".join(bytes([0x41 | on, 0]) + units[30 * k : 30 * k + 30] for k in range(parts))

    place = lambda n: (8 + n - 2) * 512
    bitmap = bytes([0x81]) + bytes(19) + struct.pack("<IQ", 3, 5)
    put(image, place(2), bitmap + group("live.txt", 4, 700) + group("a long deleted name.bin", 10, 1200, live=False, in_a_row=True) + group("sub", 5, 512, folder=True))
    put(image, place(5), group("inner", 14, 100, live=False))
    put(image, place(3), bits(40, [0, 1, 2, 3, 4]))
    put(image, place(10), b"." * 508 + b"walletdescriptor")
    put(image, place(14), b"channel.db")
    put(image, place(30), b"activeblock")
    return image


def test_exfat():
    own = ExfatVolume(reader(exfat()))
    got = {e.name: e for e in own.entries()}
    assert set(got) == {"live.txt", "a long deleted name.bin", "inner"}
    place = lambda n: (8 + n - 2) * 512
    assert got["live.txt"].extents == [(place(4), 512), (place(6), 188)] and not got["live.txt"].deleted
    assert got["a long deleted name.bin"].extents == [(place(10), 1200)] and got["inner"].extents == [(place(14), 100)] and got["inner"].deleted
    assert own.free() == [(place(7), 35 * 512)]


def test_probe_and_partition_tables():
    images = {"ntfs": ntfs(), "ext": ext(), "exfat": exfat()}
    for kind, image in images.items():
        assert open_volume(reader(image))[0] == kind and volumes_of(reader(image)) == [(0, kind)]
    disk = bytearray(2048 * 512)
    for k, (start, kind) in enumerate([(63, "ntfs"), (400, "ext"), (900, "exfat"), (1500, None)]):
        put(disk, 446 + 16 * k, struct.pack("<B3xB3xII", 0, 7, start, 300))
        put(disk, start * 512, images.get(kind, b"nothing"))
    put(disk, 510, b"\x55\xaa")
    assert volumes_of(reader(disk)) == [(63 * 512, "ntfs"), (400 * 512, "ext"), (900 * 512, "exfat")]
    with pytest.raises(ValueError, match="offset 512"):
        volumes_of(reader(disk), 512)
    with pytest.raises(ValueError):
        volumes_of(reader(bytearray(4096)))
    put(disk, 63 * 512, bytes(1400 * 512))
    with pytest.raises(ValueError, match="none opens: mbr 0"):
        volumes_of(reader(disk))


def test_damaged_volumes_end_or_refuse():
    for make, volume in ((ntfs, NtfsVolume), (ext, ExtVolume), (exfat, ExfatVolume)):
        whole = make()
        for cut in (0, 300, 1500, 5000, len(whole) // 2):
            try:
                own = volume(reader(whole[:cut]))
                list(own.entries())
                own.free()
            except (ValueError, struct.error):
                pass
    looped = exfat()
    put(looped, 1024 + 4 * 4, struct.pack("<I", 4))
    assert len(next(e for e in ExfatVolume(reader(looped)).entries() if e.name == "live.txt").extents) == 1


def test_scans_of_volumes(spark, tmp_path):
    def hits(image, base=0):
        path = tmp_path / "v.img"
        path.write_bytes(image)
        names = [r.name for r in inventory(spark, str(path)).collect()]
        gone = sorted((r.needle, r.offset, r.file_name) for r in deleted_hits(spark, str(path), NEEDLES).collect())
        return names, gone, {(r.needle, r.offset) for r in free_hits(spark, str(path), NEEDLES).collect()}

    names, gone, free = hits(ntfs())
    assert "live file.txt" in names and [(n, f) for n, _, f in gone] == [("bestblock", "small.txt"), ("wallet.dat", "gone.bin")] and ("keymeta", 100 * 512) in free
    _, gone, free = hits(ext())
    assert gone == [("acentry", 20 * 1024, "inode:14")] + [("hdseed", 12 * 1024 + 590, "gone.bin")] and ("defaultkey", 50 * 1024) in free
    place = lambda n: (8 + n - 2) * 512
    _, gone, free = hits(exfat())
    assert gone == [("channel.db", place(14), "inner"), ("walletdescriptor", place(10) + 508, "a long deleted name.bin")] and ("activeblock", place(30)) in free


def test_pieces_and_bits():
    assert packed([(0, 5), (5, 5), (20, 5)], 12) == [(0, 10), (20, 2)] and packed([]) == []
    assert clear_bits(b"\x0f\x80", 16) == [(4, 11)] and clear_bits(b"\xff", 8) == [] and clear_bits(b"\0", 5) == [(0, 5)]
