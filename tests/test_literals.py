"""The block contract: each hit once, at every place around a block's edge."""

import random

import pytest

from tracewell.functions.scalars import latin
from tracewell.model import BLOCK, ScanOptions
from tracewell.operators import literals
from tracewell.plans.evidence import NEEDLES
from tracewell.sources.files import byte_ranges, window_hits


def scanned(spark, *bodies, start=0):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(str(i), bytearray(b)) for i, b in enumerate(bodies)], "target string, data binary")
    return literals.literal_hits(rows.withColumn("raw", latin(F.col("data"))), NEEDLES, start)


def block_loop(data, start=0):
    """A model of the scan: blocks with an overlap, a needle at most once a block."""
    out = set()
    for at in range(start, len(data), BLOCK):
        begin = max(start, at - 2048)
        window = data[begin : at + BLOCK]
        for n in NEEDLES:
            k = window.find(n.encode())
            while k >= 0:
                if begin + k + len(n) > at:
                    out.add((n, begin + k, at))
                    break
                k = window.find(n.encode(), k + 1)
    return out


@pytest.mark.parametrize("start", [0, 1000])
def test_first_in_block_equals_block_loop(spark, start):
    rng = random.Random(3)
    bodies = []
    for k in range(40):
        data = bytearray(rng.choice(b"abc \x00\xff\n") for _ in range(rng.choice([0, 1, 4095, 4096, 4097, 9000, 12288])))
        for _ in range(rng.randrange(6)):
            n = rng.choice(NEEDLES).encode()
            at = rng.choice([0, max(0, len(data) - len(n)), 4096 - k % 20, 8192 - k % 20, rng.randrange(len(data) + 1)])
            if at + len(n) <= len(data):
                data[at : at + len(n)] = n
        bodies.append(bytes(data))
    got = literals.first_in_block(scanned(spark, *bodies, start=start)).collect()
    for i, data in enumerate(bodies):
        assert {(r.needle, r.offset, r.block_offset) for r in got if r.target == str(i)} == block_loop(data, start)


def test_byte_ranges_find_each_hit_once(spark, tmp_path):
    rng = random.Random(5)
    data = bytearray(rng.randbytes(3 << 20))
    places = [0, 4090, (1 << 20) - 5, (1 << 20) + 50, (2 << 20) - 3, len(data) - 9]
    for at in places:
        data[at : at + 9] = b"bestblock"
    path = tmp_path / "image"
    path.write_bytes(data)
    rows = window_hits(byte_ranges(spark, str(path), size=1 << 20), NEEDLES).collect()
    assert sorted(r.offset for r in rows) == places
    assert all(r.block_offset == (r.offset + 8) // BLOCK * BLOCK for r in rows)


def test_noise_is_silent(spark):
    assert scanned(spark, random.Random(42).randbytes(1 << 20)).count() == 0


def test_options_refuse_unknown_profiles():
    with pytest.raises(ValueError):
        ScanOptions(profile="other")
