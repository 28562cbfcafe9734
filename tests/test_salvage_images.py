"""Images put together from pages of both database families."""

import random
import sqlite3
import struct

from tracewell.operators import salvage
from tracewell.plans.containers import page_image


def database(tmp_path, rows=300, size=1024):
    path = tmp_path / f"{rows}-{size}.db"
    path.unlink(missing_ok=True)
    con = sqlite3.connect(path)
    con.execute(f"pragma page_size = {size}")
    con.execute("create table t (k integer primary key, v text)")
    con.executemany("insert into t values (?, ?)", [(k, f"value {k} " * 5) for k in range(rows)])
    con.execute("create index i on t (v)")
    con.commit()
    con.close()
    return path.read_bytes()


def test_whole_and_shuffled_trees(tmp_path):
    for size in (1024, 4096):
        data = database(tmp_path, size=size)
        got = salvage.salvage(b"." * 77 + data + b"~" * 99)
        assert (got["kind"], got["page_size"], got["complete"], got["ordered"], got["verdict"], got["reasons"]) == ("sqlite", size, True, True, "valid", [])
        assert got["image"] == data and got["pages"][0] == {"pgno": None, "offset": 77, "size": size, "kind": "sqlite-master"} and got["runs"] == [{"start_offset": 77, "pages": len(data) // size}]
        pages = [data[k : k + size] for k in range(0, len(data), size)]
        mixed = pages[3:] + pages[:3]
        got = salvage.salvage(b"#" * 5 + b"##".join(mixed))
        assert len(got["pages"]) == len(pages) and got["complete"] and not got["ordered"] and got["verdict"] == "suspect" and got["image"] == b"".join(mixed)
        headless = salvage.salvage(b"".join(pages[1:]))
        assert headless["page_size"] == size and len(headless["pages"]) == len(pages) - 1 and not headless["complete"] and "page 1 missing" in headless["reasons"][0]
    damaged = bytearray(database(tmp_path))
    damaged[5 * 1024] = 99
    got = salvage.salvage(bytes(damaged))
    assert len(got["pages"]) == len(damaged) // 1024 - 1 and not got["complete"] and not got["ordered"]


def test_numbered_pages_and_their_doubts():
    def page(number, kind=5, entries=2, free=400, last=3):
        if not number:
            return (struct.pack("<IIIIIIIII", 7, 0, 0, 0x053162, 9, 512, 0, 0, last)).ljust(512, b"\0")
        return (struct.pack("<IIIII", 7, 0, number, 0x053162, 9) + struct.pack("<HH", entries, free) + bytes([1, kind])).ljust(512, b"k")

    # data pages don't carry the magic in real files; those that do are told from metas by their number alone
    got = salvage.salvage(b"xx" + b"-".join(page(k) for k in (2, 0, 3, 1)))
    assert (got["kind"], got["page_size"], got["complete"], [p["pgno"] for p in got["pages"]]) == ("bdb", 512, True, [0, 1, 2, 3]) and len(got["runs"]) == 4
    lost = salvage.salvage(page(0) + page(1) + page(3))
    assert not lost["complete"] and any("number 0" in r or "all zero" in r for r in lost["reasons"]) and len(lost["image"]) == 2048 and lost["runs"][0] == {"start_offset": 0, "pages": 2}
    assert salvage.salvage(page(0)) is None and salvage.salvage(b"") is None and salvage.salvage(random.Random(1).randbytes(100_000)) is None


def test_salvaged_rows(spark, tmp_path):
    rows = [("b", bytearray(page_image(3))), ("s", bytearray(database(tmp_path))), ("n", None), ("x", bytearray(b"nothing"))]
    got = {r.target: r for r in salvage.salvaged(spark.createDataFrame(rows, "target string, data binary")).collect()}
    assert set(got) == {"b", "s"} and got["s"].verdict == "valid" and got["b"].kind == "bdb" and [p.pgno for p in got["b"].pages] == list(range(8))
    assert salvage.salvaged(spark.createDataFrame([], "target string, data binary")).count() == 0
