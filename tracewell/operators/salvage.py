"""Database pages in raw bytes: header scan, identity vote, page size, page table and runs; images put together from them.

The page table of the first family is relational, as its pages carry numbers. An image is a row, so a source whose pages
are put together must fit one (MOST bytes); its bytes are looked at once, by tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import first_of, plurality

MAGICS, SIZES = (0x053162, 0x061561), (512, 1024, 2048, 4096, 8192, 16384, 32768, 65536)
MOST = 1 << 30
# The types of numbered pages that hold items, that of an overflow page, and the first bytes of the other family.
ITEM_PAGES, OVERFLOW = (3, 4, 5, 6, 7, 8, 12, 13), 7
SQLITE, SQLITE_TREES = b"SQLite format 3\0", {2: (12, 5), 5: (12, 5), 10: (8, 2), 13: (8, 3)}  # type: (header, least cell)


def headers(sources: DataFrame) -> DataFrame:
    """(target, offset, magic, version, log_file, pgno, named_size, size) of every page header at any byte offset."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer((data or b"") + bytes(8), np.uint8).astype(np.uint32)
                word = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
                n = max(0, len(data or b"") - 19)
                at = np.flatnonzero(np.isin(word[12 : 12 + n], MAGICS))
                at = at[(word[at + 16] >= 5) & (word[at + 16] <= 10) & (word[at + 8] < 1 << 24)]
                cols = [at, word[at + 12], word[at + 16], word[at], word[at + 8], word[at + 20] if len(at) else at, np.full(len(at), len(data or b""))]
                arrays = [pa.array([target] * len(at), pa.string())] + [pa.array(c.astype(np.int64)) for c in cols]
                yield pa.RecordBatch.from_arrays(arrays, ["target", "offset", "magic", "version", "log_file", "pgno", "named_size", "size"])

    return sources.select("target", "data").mapInArrow(scan, "target string, offset bigint, magic bigint, version bigint, log_file bigint, pgno bigint, named_size bigint, size bigint")


def pages(sources: DataFrame) -> DataFrame:
    """The page table of each target's largest database: (target, pgno, offset, page_size), clipped pages left out and
    the first of each number kept. The page size is named by page 0, else the size with the fullest offset class."""
    found = headers(sources).withColumn("identity", F.concat_ws("/", "magic", "version", "log_file"))
    chosen = plurality(found, ["target"], "identity", "offset").where("votes > 1").select("target", "identity")
    own = found.join(chosen, ["target", "identity"])
    named = own.where((F.col("pgno") == 0) & F.col("named_size").isin(*SIZES)).groupBy("target").agg(F.min_by("named_size", "offset").alias("named"))
    votes = own.select("target", F.explode(F.array(*map(F.lit, SIZES))).alias("s"), "offset").groupBy("target", "s", (F.col("offset") % F.col("s")).alias("class")).agg(F.count("*").alias("n"))
    voted = first_of(votes.groupBy("target", "s").agg(F.max("n").alias("n")).where("n > 1"), ["target"], [F.desc("n"), F.col("s")]).select("target", F.col("s").alias("voted"))
    sized = own.join(named, "target", "left").join(voted, "target", "left").withColumn("page_size", F.coalesce("named", "voted"))
    whole = sized.where("offset + page_size <= size").select("target", "pgno", "offset", "page_size")
    return first_of(whole, ["target", "pgno"], [F.col("offset")])


def runs(table: DataFrame) -> DataFrame:
    """Consecutive page numbers at consecutive offsets: (target, start_offset, pages)."""
    w = Window.partitionBy("target").orderBy("pgno")
    joined = (F.col("pgno") == F.lag("pgno").over(w) + 1) & (F.col("offset") == F.lag("offset").over(w) + F.col("page_size"))
    rows = table.withColumn("new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("target", "run").agg(F.min_by("offset", "pgno").alias("start_offset"), F.count("*").cast("int").alias("pages")).drop("run")


def verdicts(table: DataFrame) -> DataFrame:
    """target, page_size, pages, complete: complete needs pages 0 to the greatest."""
    return table.groupBy("target").agg(F.first("page_size").alias("page_size"), F.count("*").alias("pages"), F.max("pgno").alias("last")).withColumn("complete", F.col("pages") == F.col("last") + 1)


def numbered_pages(data: bytes) -> tuple[int, list[tuple[int, int]]] | None:
    """(page size, [(number, offset)]) of the database with the most page headers in data, by number, the first of each."""
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    word = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    at = np.flatnonzero(np.isin(word[12 : 12 + max(0, len(data) - 19)], MAGICS))
    at = at[(word[at + 16] >= 5) & (word[at + 16] <= 10) & (word[at + 8] < 1 << 24)]
    groups: dict[tuple, list[int]] = {}
    for a in at.tolist():
        groups.setdefault((word[a + 12], word[a + 16], word[a]), []).append(a)
    own = max(groups.values(), key=len, default=[])
    if len(own) < 2:
        return None
    size = next((int(word[a + 20]) for a in own if word[a + 8] == 0 and word[a + 20] in SIZES), 0)
    if not size:
        votes = {s: int(np.unique(np.array(own) % s, return_counts=True)[1].max()) for s in SIZES}
        size = max(SIZES, key=lambda s: (votes[s], -s))
        if votes[size] < 2:
            return None
    pages: dict[int, int] = {}
    for a in own:
        if a + size <= len(data):
            pages.setdefault(int(word[a + 8]), a)
    return (size, sorted(pages.items())) if len(pages) > 1 else None


def is_tree_page(data: bytes, page: int, size: int, total: int = 0, first: bool = False) -> bool:
    """Is this a page of a tree: a known type, cells that fit, pointers within the page and distinct, and for an inner page
    a last child within the database (total pages, if known)? On the first page the tree follows a header of 100 bytes."""
    lead = 100 if first else 0
    if page + size > len(data) or (kind := SQLITE_TREES.get(data[page + lead])) is None:
        return False
    head, least = kind
    cells, content = (int.from_bytes(data[page + lead + k : page + lead + k + 2]) for k in (3, 5))
    content = content or (65536 if size == 65536 else 0)
    if not content or content > size or lead + head + 2 * cells > content:
        return False
    if not cells:
        return content == size
    places = np.frombuffer(data, ">u2", cells, page + lead + head)
    if places.min() < content or int(places.max()) + least > size or len(np.unique(places)) < cells:
        return False
    return head == 8 or not total or 0 < int.from_bytes(data[page + lead + 8 : page + lead + 12]) <= total


def tree_pages(data: bytes) -> tuple[int, int, int | None, list[int]] | None:
    """(page size, pages by the header or 0, offset of the first page or None, offsets of all pages) of the database in data.
    Without a header the size that finds most pages counts; of pages that overlap the first does."""
    at = data.find(SQLITE)
    while at >= 0 and at + 100 <= len(data):
        size, total = int.from_bytes(data[at + 16 : at + 18]), int.from_bytes(data[at + 28 : at + 32])
        size, total = 65536 if size == 1 else size, total if 0 < total < 1 << 24 else 0
        if size in SIZES and is_tree_page(data, at, size, total, True):
            found = _tree_pages(data, size, total, at)
            if len(found) > 1:
                return size, total, at, found
            break
        at = data.find(SQLITE, at + 1)
    best = max(((s, _tree_pages(data, s, 0, None)) for s in (1024, 2048, 4096, 8192)), key=lambda x: len(x[1]))
    return (best[0], 0, None, best[1]) if len(best[1]) > 1 else None


def _tree_pages(data: bytes, size: int, total: int, first: int | None) -> list[int]:
    raw, n = np.frombuffer(data, np.uint8), max(0, len(data) - size + 1)
    at = np.flatnonzero(np.isin(raw[:n], list(SQLITE_TREES)))
    wide = lambda k: raw[at + k].astype(np.int64) << 8 | raw[at + k + 1]
    content = np.where(wide(5) == 0, 65536, wide(5))
    at = at[(content <= size) & (8 + 2 * wide(3) <= content) & (wide(3) > 0) | (wide(3) == 0) & (content == size)]
    at = np.union1d(at, [first]) if first is not None else at
    out: list[int] = []
    for a in at.tolist():
        if (not out or a >= out[-1] + size) and is_tree_page(data, a, size, total, a == first):
            out.append(a)
    return out


def _source_runs(pages: list[tuple[int, int]], size: int) -> list[dict]:
    """Pages (number, offset) that follow each other both by number and in the source."""
    runs: list[dict] = []
    for k, (number, at) in enumerate(pages):
        if not k or (number, at) != (pages[k - 1][0] + 1, pages[k - 1][1] + size):
            runs.append({"start_offset": at, "pages": 0})
        runs[-1]["pages"] += 1
    return runs


def _numbered_doubts(image: bytes) -> list[str]:
    size, count, doubts = int.from_bytes(image[20:24], "little"), 0, []
    u = lambda b, a, n=4: int.from_bytes(b[a : a + n], "little")
    if u(image, 12) not in MAGICS:
        doubts.append(f"meta page: bad magic {u(image, 12):#x}")
    if not 5 <= u(image, 16) <= 10:
        doubts.append(f"meta page: version {u(image, 16)} outside 5..10")
    if size not in SIZES:
        return [*doubts, f"meta page: page size {size}"]
    count = len(image) // size
    if len(image) % size or count < 2:
        return [*doubts, f"image of {len(image)} bytes in pages of {size}"]
    if u(image, 32) != count - 1:
        doubts.append(f"meta names {u(image, 32)} as the last page, image holds {count}")
    for k in range(count):
        page = image[k * size : (k + 1) * size]
        if u(page, 8) != k:
            doubts.append(f"page {k} carries number {u(page, 8)}")
        elif not any(page):
            doubts.append(f"page {k} is all zero (unfilled gap)")
        elif u(page, 12) in MAGICS:
            if not 5 <= u(page, 16) <= 10 or u(page, 20) != size:
                doubts.append(f"page {k}: meta of version {u(page, 16)} and page size {u(page, 20)}")
        elif page[25] not in ITEM_PAGES:
            doubts.append(f"page {k}: type {page[25]} is not a database page type")
        elif page[25] != OVERFLOW and not 26 + 2 * u(page, 20, 2) <= u(page, 22, 2) <= size:
            doubts.append(f"page {k}: {u(page, 20, 2)} index entries overrun free space at {u(page, 22, 2)}")
    return doubts


def _tree_doubts(image: bytes, size: int, total: int, runs: int, ordered: bool) -> list[str]:
    if not image.startswith(SQLITE):
        return ["no header at image start (page 1 missing or not first)"]
    count = len(image) // size
    doubts = ["header page count unreadable"] if not total else [f"image holds {count} pages, header says {total}"] if count != total else []
    doubts += [f"page {k + 1} fails b-tree validation" for k in range(count) if not is_tree_page(image, k * size, size, total, not k)]
    return doubts if ordered else [*doubts, f"{runs} source runs (page order uncertain)"]


def salvage(data: bytes) -> dict | None:
    """What can be put together from data: kind, page_size, pages, runs, complete, ordered, verdict, reasons and image. The
    first family by page number, gaps zero; else the other by place in the source. Valid means worth opening, no more."""
    if found := numbered_pages(data):
        size, pages = found
        if (pages[-1][0] + 1) * size <= MOST:
            image = bytearray((pages[-1][0] + 1) * size)
            for number, at in pages:
                image[number * size : (number + 1) * size] = data[at : at + size]
            doubts = _numbered_doubts(bytes(image))
            table = [{"pgno": n, "offset": at, "size": size, "kind": "bdb-page" if n else "bdb-meta"} for n, at in pages]
            whole = len(pages) == pages[-1][0] + 1 and pages[0][0] == 0
            return _salvaged("bdb", size, table, _source_runs(pages, size), whole, True, doubts, bytes(image))
    if not (trees := tree_pages(data)):
        return None
    size, total, first, places = trees
    image = b"".join(data[a : a + size] for a in places)
    runs = _source_runs(list(enumerate(places)), size)
    ordered = len(runs) == 1 and places[0] == first
    table = [{"pgno": None, "offset": a, "size": size, "kind": "sqlite-master" if a == first else "sqlite-btree"} for a in places]
    return _salvaged("sqlite", size, table, runs, first in places and total == len(places), ordered, _tree_doubts(image, size, total, len(runs), ordered), image)


def _salvaged(kind: str, size: int, pages: list[dict], runs: list[dict], complete: bool, ordered: bool, doubts: list[str], image: bytes) -> dict:
    verdict = "suspect" if doubts else "valid"
    return {"kind": kind, "page_size": size, "pages": pages, "runs": runs, "complete": complete, "ordered": ordered, "verdict": verdict, "reasons": doubts, "image": image}


SALVAGED = (
    "target string, kind string, page_size int, pages array<struct<pgno:bigint,offset:bigint,size:int,kind:string>>, runs array<struct<start_offset:bigint,pages:int>>,"
    "complete boolean, ordered boolean, verdict string, reasons array<string>, image binary"
)


def salvaged(sources: DataFrame) -> DataFrame:
    """A row per source (target, data) that holds two and more pages of one database: SALVAGED."""
    fields = pa.schema([
        ("target", pa.string()), ("kind", pa.string()), ("page_size", pa.int32()), ("pages", pa.list_(pa.struct([("pgno", pa.int64()), ("offset", pa.int64()), ("size", pa.int32()), ("kind", pa.string())]))),
        ("runs", pa.list_(pa.struct([("start_offset", pa.int64()), ("pages", pa.int32())]))), ("complete", pa.bool_()), ("ordered", pa.bool_()), ("verdict", pa.string()), ("reasons", pa.list_(pa.string())), ("image", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data and len(data) <= MOST and (found := salvage(data)):
                    yield pa.RecordBatch.from_pylist([{"target": target, **found}], fields)

    return sources.select("target", "data").mapInArrow(run, SALVAGED)
