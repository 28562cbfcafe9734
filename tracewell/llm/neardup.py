"""Near-duplicate documents: MinHash with banding, verification, and connected components.

1. Each document's distinct word shingles get 160 universal-hash minima, kept as 16-bit numbers, in 40 bands of 4. At a
   similarity of 0.75 a pair shares no band with a chance of about 1 in 4 million. Documents of equal sets form a class,
   known by a 128-bit digest of its sorted shingles, and only one of a class, its representative, goes on.
2. In each bucket of a band all members are held against the bucket's least member: signatures first (a pair whose
   signatures agree in under 55 % is 5.8 standard deviations from 0.75), then the full sets. This settles most members
   of large groups with one comparison each.
3. In buckets that hold several components still, every pair of different components that no earlier band has brought
   together is compared by signatures, and those that pass by their full sets, the most similar first, until the two
   are connected. Only confirmed links leave the task, so their number stays below that of the members. Buckets
   of over `block` members are compared block against block.
4. Components by alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import Sieve, documents, short_batches, written
from .components import components

BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
AGREE = 0.55
_rng = np.random.Generator(np.random.PCG64(75))
_A = (_rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of fewer words has one, of all its words."""
    start, end, first = kernels.words(raw, at)
    word = kernels.word_hashes(raw, start, end, lower=True)
    runs = kernels.window_hashes(word, width)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:
            out.append(kernels.window_hashes(word[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 256):
        np.minimum(least, (_A * x[a : a + 256] + _B).min(1), out=least)
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype("<u2")


def features(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.chunks(batches, "text"):
            sets = shingle_sets(*kernels.utf8(batch.column("text")), width)
            digests = b"".join([kernels.digest(s.tobytes()) for s in sets])
            one, two = np.frombuffer(digests, "<i8").reshape(-1, 2).T.copy()
            signs = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
            size = pa.array(list(map(len, sets)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(one), pa.array(two), signs], ["doc_id", "n_shingles", "h1", "h2", "sign"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sign binary")


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def band_keys(signs: np.ndarray) -> np.ndarray:
    own = np.ascontiguousarray(signs).view("<u8")
    return kernels.mix(own + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64)


def bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_signs(batch.column("sign")))
                ids = np.repeat(batch.column("id").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return classes.select("id", "sign").mapInArrow(kernels.released(run), "key long, id long")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents in ids (a column id, distinct). A sieve drops most others before the shuffle."""
    rows = Sieve(ids, "id").passing(docs.select(F.col("doc_id").alias("id"), "text"), "id").join(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.chunks(batches, "text"):
            sets = shingle_sets(*kernels.utf8(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])

    return rows.select("id", "text").mapInArrow(run, "id long, shingles binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _alike(agree: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = (_signs(batch.column("sa")) == _signs(batch.column("sb"))).mean(1) >= agree
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())
            keep = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no group (key, part), by which the rows are sorted, is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
        new = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        last = int(new[-1]) if len(new) else 0
        if held and (held[-1].column("key")[-1].as_py() != key[0] or held[-1].column("part")[-1].as_py() != part[0]):
            yield pa.concat_batches(held)
            held = []
        if last:
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def _pairs(batch: pa.RecordBatch, signs: np.ndarray, agree: float, step: int = 30_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, agreement) of the pairs that this batch's buckets have to settle."""
    key, part, side, comp = (batch.column(c).to_numpy() for c in ("key", "part", "side", "comp"))
    n = len(key)
    cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True]]))
    ends = np.repeat(cut[1:], np.diff(cut))
    partners = ends - np.arange(n) - 1
    total = np.cumsum(partners)
    keys = band_keys(signs)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + step, "right")))
        i = np.repeat(np.arange(a, b), partners[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[a:b] - partners[a:b] - (total[a - 1] if a else 0), partners[a:b])
        a = b
        wanted = (comp[i] != comp[j]) & (side[i] != side[j])
        i, j = i[wanted], j[wanted]
        for x in range(0, len(i), step):
            p, q = i[x : x + step], j[x : x + step]
            same = (signs[p] == signs[q]).mean(1)
            good = same >= agree
            p, q, same = p[good], q[good], same[good]
            shared = keys[p] == keys[q]
            first = keys[p, shared.argmax(1)] == key[p]  # else an earlier band's bucket settles the pair
            if first.any():
                yield p[first], q[first], same[first]


def _open_members(agree: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            found = np.zeros(batch.num_rows, bool)
            for i, j, _ in _pairs(batch, _signs(batch.column("sign")), agree):
                found[i] = found[j] = True
            yield batch.select(["key", "id", "comp"]).filter(pa.array(found))

    return run


def _new_links(percent: int, agree: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            ids, comp = batch.column("id").to_numpy(), batch.column("comp").to_numpy()
            sets = [np.frombuffer(x, "<u8") for x in batch.column("shingles").to_pylist()]
            found = list(_pairs(batch, _signs(batch.column("sign")), agree))
            out, root = [], {}

            def top(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            if found:
                i, j, same = (np.concatenate(x) for x in zip(*found))
                for p, q in zip(*(x[np.argsort(-same, kind="stable")].tolist() for x in (i, j))):
                    if (x := top(int(comp[p]))) != (y := top(int(comp[q]))) and linked(sets[p], sets[q], percent):
                        root[max(x, y)] = min(x, y)
                        out.append((ids[p], ids[q]))
            a, b = zip(*out) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """Adds part and side, and deals the rows out by bucket: a bucket of n members has ceil(n / block) blocks, and each
    pair of blocks is a part of its own; within a part only rows of different sides are compared, except in a single
    block, where every row is its own side."""
    size = members.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    size = written(size.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "open-buckets")
    rows = members.join(size, "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("part", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    rows = rows.withColumn("side", F.when(F.col("own") == F.col("other"), F.monotonically_increasing_id() + 2).otherwise((F.col("own") > F.col("other")).cast("long")))
    return rows.drop("blocks", "own", "other")


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, block: int = 2048, agree: float = AGREE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    docs needs doc_id and text; other columns are ignored. Null, empty and blank texts have no shingle and link with
    nothing. A null doc_id takes no part: its component_id is null and it is kept. Rows that repeat a doc_id are one
    document with several texts: whatever links with one of them is in its component. docs is read several times.
    An empty table gives an empty result. Texts of any length are compared whole. agree: the share of a signature in
    which a pair must agree before its full sets are compared (0.55 is 5.8 deviations below 0.75); with 0 every pair
    that shares a band is compared in full.
    """
    short_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = written(features(docs, width), "shingles")
    whole = rows.where("doc_id is not null and n_shingles > 0")
    classes = written(whole.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.min_by("sign", "doc_id").alias("sign")), "classes")
    keys = bands(classes)
    buckets = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    buckets = written(buckets.select("key", "leader"), "buckets")  # tables on both sides let hot keys be split over tasks
    members = written(keys.join(buckets, "key"), "members")

    signs = classes.select("id", "sign")
    pairs = members.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(signs.select(F.col("id").alias("a"), F.col("sign").alias("sa")), "a").join(signs.select(F.col("id").alias("b"), F.col("sign").alias("sb")), "b")
    pairs = written(pairs.mapInArrow(kernels.released(_alike(agree)), "a long, b long"), "alike")
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    sets = sets_of(docs, ids, width)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
    links = written(both.mapInArrow(kernels.released(_confirm(percent)), "a long, b long"), "confirmed")
    first = components(links)

    named = written(members.select("key", "id").join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")), "named")
    open_rows = _dealt(named, block).join(signs, "id").repartition("key", "part").sortWithinPartitions("key", "part", "side")
    left = written(open_rows.select("key", "part", "side", "id", "comp", "sign").mapInArrow(kernels.released(_open_members(agree)), "key long, id long, comp long").distinct(), "open")
    more = _dealt(left, block).join(signs, "id").join(sets_of(docs, left.select("id").distinct(), width), "id")
    more = more.repartition("key", "part").sortWithinPartitions("key", "part", "side")
    found = written(more.select("key", "part", "side", "id", "comp", "sign", "shingles").mapInArrow(kernels.released(_new_links(percent, agree)), "a long, b long"), "found")
    last = components(links.unionAll(found)) if not found.isEmpty() else first

    own = rows.select("doc_id", "n_shingles", "h1", "h2")
    named = own.join(classes.select("h1", "h2", F.col("id").alias("rep")), ["h1", "h2"], "left").join(last.withColumnRenamed("id", "rep"), "rep", "left")
    part = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.least(part, "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


ORACLE_SQL = """
with recursive split as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
shingle as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from split)),
size as (select doc_id, count(*) as n from shingle group by doc_id),
pair as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (
  select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
edge as (select a, b from link union select b, a from link),
reach as (select doc_id as id, doc_id as hop from documents union select reach.id, edge.b from reach join edge on edge.a = reach.hop)
select d.doc_id, coalesce(size.n, 0)::bigint as n_shingles, r.c as component_id, d.doc_id = r.c as kept
from documents d left join size using (doc_id) join (select id, min(hop) as c from reach group by id) r on r.id = d.doc_id"""

QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}
ORACLE = {"op2_minhash_near_dedup": ORACLE_SQL}
