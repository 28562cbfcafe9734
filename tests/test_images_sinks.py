"""Images of version 1, and sinks."""

import json
import random
import struct
import xml.etree.ElementTree as ET
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.functions.scalars import latin
from tracewell.operators import carving, literals
from tracewell.plans.evidence import NEEDLES
from tracewell.sources import images, sinks
from tracewell.sources.files import window_hits


def ewf(media, chunk_bytes=4096, packed=lambda n: n % 2 == 0):
    def section(kind, at, body):
        head = kind.ljust(16, b"\0") + struct.pack("<QQ", at + 76 + len(body), 76 + len(body)) + bytes(40)
        return head + struct.pack("<I", zlib.adler32(head)) + body

    out = images.SIGNATURE + b"\x01\x01\x00\x00\x00"
    chunks = [media[a : a + chunk_bytes] for a in range(0, len(media), chunk_bytes)]
    out += section(b"volume", len(out), struct.pack("<IIIIQ", 1, len(chunks), chunk_bytes // 512, 512, len(media) // 512) + bytes(70))
    base, body, places = len(out) + 76, b"", []
    for n, c in enumerate(chunks):
        places.append((len(body), packed(n)))
        body += zlib.compress(c) if packed(n) else c + struct.pack("<I", zlib.adler32(c))
    out += section(b"sectors", len(out), body)
    table = struct.pack("<IIQII", len(chunks), 0, base, 0, 0) + b"".join(struct.pack("<I", p | z << 31) for p, z in places)
    out += section(b"table", len(out), table)
    head = b"done".ljust(16, b"\0") + struct.pack("<QQ", len(out), 76) + bytes(40)
    return out + head + struct.pack("<I", zlib.adler32(head))


def test_image_scan(spark, tmp_path):
    media = bytearray(random.Random(1).randbytes(4096 * 9 + 512))
    places = [0, 4090, 8192, 4096 * 9 + 400]
    for at in places:
        media[at : at + 9] = b"bestblock"
    path = tmp_path / "case.E01"
    path.write_bytes(ewf(bytes(media)))
    rows = window_hits(images.image_windows(spark, str(path)), NEEDLES).collect()
    assert sorted(r.offset for r in rows) == places
    data = bytearray(ewf(bytes(media), packed=lambda n: False))
    data[data.index(bytes(media[:64])) + 20] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        images.image_windows(spark, str(path)).collect()
    with pytest.raises(ValueError):
        images.layout(str(tmp_path / "other.bin"))


def test_sinks(spark, tmp_path):
    bodies = [b"a <tag> wallet.dat and hdseed", b"zz crypted_key"]
    own = spark.createDataFrame([(f"t&{i}", bytearray(b)) for i, b in enumerate(bodies)], "target string, data binary").withColumn("raw", latin(F.col("data")))
    hits = literals.literal_hits(own, NEEDLES)
    sinks.dfxml(hits, str(tmp_path / "d.xml"))
    tree = ET.parse(tmp_path / "d.xml").getroot()
    assert [(o.find("filename").text, o.find("label").text) for o in tree.iter("fileobject")] == [("t&0", "wallet.dat"), ("t&0", "hdseed"), ("t&1", "crypted_key")]
    carves = carving.numbered(carving.carved(hits.join(own.select("target", "data"), "target"), 4))
    assert sinks.carve_files(carves, str(tmp_path / "c")).count() == 3
    assert (tmp_path / "c" / "hit-000003.bin").read_bytes() == b" zz crypted_key"[1:] and json.loads((tmp_path / "c" / "hit-000001.json").read_text())["needle"] == "wallet.dat"
    assert sorted(p.suffix for p in (tmp_path / "c").iterdir()) == [".bin"] * 3 + [".json"] * 3
    said = sinks.report_json(hits)
    assert said["totals"]["unique_hits"] == 3 and said["types"]["bitcoin-core-legacy"] == 2 and said["coverage_note"]
    sinks.case_log(own, spark.createDataFrame([("t&1", 0, 4)], "target string, start long, len long"), str(tmp_path / "log"))
    assert {r.target: r.status for r in spark.read.json(str(tmp_path / "log")).collect()} == {"t&0": "complete", "t&1": "partial"}
    assert [r.value for r in sinks.token_list(own, 3).collect()] == ["tag", "wallet", "dat"]
