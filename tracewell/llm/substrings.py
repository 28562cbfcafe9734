"""Substring deduplication by Rabin-Karp hashes of every window of a fixed number of words.

Every window of every text is hashed. Which windows can stand in two documents is found first through anchors: the
least hash among the half-length windows inside a window. Equal windows have equal anchors, so a window whose anchor no
other document has can't repeat; only the others are dealt out and counted, under two hashes of 61 bits (each from its
own half of the words' digests, at its own base), with the least document id of each. Equal hashes count as equal words:
two different windows of 10**13 share both with a chance of about 1e-11. Anchors are about a thirteenth as many as windows, and only those of one
document of a group of equal texts are dealt out: the rest of the group repeat it from end to end.

Repeated windows of a document merge into maximal removal intervals. Counts are aggregated before every shuffle, and
hot windows are joined back with skew handling, so a passage that a third of all documents share stays spread out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import Sieve, documents, short_batches, written


def anchors(word: np.ndarray, width: int) -> np.ndarray:
    """The anchor of the window at each word: the least hash of the half-length windows inside it."""
    half = max(1, width // 2)
    least = kernels.window_hashes(word, half)
    span, have = width - half + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        have += step
    return least


def _row_key(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a digest of each text's sequence of words, from the words' own digests."""
    each = [kernels.digest(word[a:b].tobytes()) for a, b in zip(first.tolist(), first[1:].tolist())]
    both = np.frombuffer(b"".join(each), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.chunks(batches, "text"):
            raw, at = kernels.utf8(batch.column("text"))
            start, end, first = kernels.words(raw, at)
            word = kernels.word_digests(raw, start, end)
            one, two = _row_key(word, first)
            places, _ = kernels.window_owner(first, width)
            least = anchors(word[:, 0], width)[places].view(np.int64)
            cut = np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - width + 1, 0))])
            own = [np.unique(least[a:b]) for a, b in zip(cut.tolist(), cut[1:].tolist())]
            offsets = np.concatenate([[0], np.cumsum(list(map(len, own)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
            arrays = [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(one), pa.array(two), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "h1", "h2", "anchors"])

    return run


def _windows(width: int):
    """The windows of each text whose anchor is among the row's shared ones: (w1, w2, doc_id, h1, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.chunks(batches, "text"):
            raw, at = kernels.utf8(batch.column("text"))
            start, end, first = kernels.words(raw, at)
            word = kernels.word_digests(raw, start, end)
            places, owner = kernels.window_owner(first, width)
            least = anchors(word[:, 0], width)[places].view(np.int64)
            shared = batch.column("shared")
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            wanted = np.zeros(len(places), bool)
            for i in range(batch.num_rows):
                wanted[cut[i] : cut[i + 1]] = np.isin(least[cut[i] : cut[i + 1]], shared[i].values.to_numpy())
            places, owner = places[wanted], owner[wanted]
            one, two = (kernels.window_hashes(word[:, k], width, k)[places].view(np.int64) for k in (0, 1))
            ids, keys = (batch.column(c).to_numpy() for c in ("doc_id", "h1"))
            arrays = [pa.array(x) for x in (one, two, ids[owner], keys[owner], (places - first[owner]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["w1", "w2", "doc_id", "h1", "place"])

    return run


def intervals(places: F.Column, width: int) -> F.Column:
    """Maximal (first, last) word intervals, last exclusive, covered by windows at the given places (sorted, distinct)."""
    starts = F.filter(places, lambda p, i: (i == 0) | (p - F.get(places, i - 1) > width))
    ends = F.filter(places, lambda p, i: (i == F.size(places) - 1) | (F.get(places, i + 1) - p > width))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), (b + width).alias("last")))


def _strip(keep: list[str], names: list[str]):
    """Removes the covered words: keeps columns, text_kept, n_words, n_removed and kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.chunks(batches, "text"):
            kept, total, removed, digest = [], [], [], []
            spans = batch.column("removal").to_pylist()
            for text, own in zip(batch.column("text").to_pylist(), spans):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n, gone = len(words), 0
                for a, b in own or []:
                    b = min(b, n)
                    gone += b - a
                    words[a:b] = [None] * (b - a)
                left = b" ".join([w for w in words if w is not None])
                kept.append(text if text is None or not gone else left.decode("utf-8", "surrogatepass"))
                total.append(n)
                removed.append(gone)
                digest.append(hashlib.sha256(left).hexdigest())
            made = {"text_kept": pa.array(kept, pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [made[c] for c in names], [*keep, *names])

    return run


_MADE = {"text_kept": "string", "n_words": "long", "n_removed": "long", "kept_sha256": "string"}


def removals(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, h1, removal): the maximal word intervals to remove of each document that has any, as (first, last)."""
    sketch = written(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_sketch(width), "doc_id long, n_words long, h1 long, h2 long, anchors array<long>"), "anchors")
    classes = sketch.where(F.col("n_words") >= width).groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    # rows that repeat an earlier document from end to end
    several = written(classes.where("n > 1").select("h1", "h2", "rep"), "copied")
    copies = sketch.select("doc_id", "h1", "h2", "n_words").join(several, ["h1", "h2"]).where("doc_id > rep")
    whole = copies.select("doc_id", "h1", F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last"))).alias("removal"))
    # the anchors of one document of each class
    own = sketch.where(F.col("n_words") >= width).join(copies.select("doc_id", "h1"), ["doc_id", "h1"], "left_anti")
    spread = own.select("doc_id", "h1", F.explode("anchors").alias("anchor"))
    shared = spread.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    shared = written(shared, "shared-anchors")  # tables on both sides of a join let hot keys be split over tasks
    wanted = written(spread.join(shared, "anchor").groupBy("doc_id", "h1").agg(F.collect_set("anchor").alias("shared")), "shared")
    rows = Sieve(wanted, "doc_id").passing(docs.select("doc_id", "text"), "doc_id").join(wanted, "doc_id")
    # a doc_id may come with several texts; the sketch's key tells them apart
    windows = written(rows.mapInArrow(_windows(width), "w1 long, w2 long, doc_id long, h1 long, place int"), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    least = written(least, "repeated-windows")
    repeats = windows.join(least, ["w1", "w2"]).where("doc_id > lo").groupBy("doc_id", "h1").agg(F.sort_array(F.collect_set("place")).alias("places"))
    return written(whole.unionAll(repeats.select("doc_id", "h1", intervals(F.col("places"), width).alias("removal"))), "removals")


def remove_repeats(docs: DataFrame, keep: list[str], names: list[str], width: int = 50) -> DataFrame:
    """keep columns of every row of docs, and what names asks for: text_kept, n_words, n_removed, kept_sha256.

    Each word covered by a window of `width` words that also starts in a document with a smaller doc_id is removed;
    windows are judged on the input. text_kept is the text itself where nothing is removed, else the kept words joined
    by blanks. docs needs doc_id and text; other columns are ignored unless kept. Null, empty and short texts lose
    nothing. A null doc_id takes no part and loses nothing. Rows that repeat a doc_id don't count as smaller than each
    other. An empty table gives an empty result; a text of any length is hashed whole.
    """
    short_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    cols = list(dict.fromkeys([*keep, "doc_id", "text"]))
    gone = removals(docs, width)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{c} {_MADE[c]}" for c in names])
    none = F.lit(None).cast("array<struct<first:int,last:int>>").alias("removal")
    rows = Sieve(gone, "doc_id").marked(docs.select(*cols), "doc_id", "touched")
    free = rows.where("not touched").select(*cols, none)
    found = rows.where("touched").drop("touched").mapInArrow(_keyed(cols), ", ".join([f"`{c}` {kinds[c]}" for c in cols] + ["h1 long"]))
    found = found.join(gone, ["doc_id", "h1"], "left").select(*cols, "removal")
    strip = _strip_rows(keep, names)
    return free.mapInArrow(strip, schema).unionAll(found.mapInArrow(strip, schema))


def _keyed(cols: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.chunks(batches, "text"):
            raw, at = kernels.utf8(batch.column("text"))
            start, end, first = kernels.words(raw, at)
            one, _ = _row_key(kernels.word_digests(raw, start, end), first)
            yield pa.RecordBatch.from_arrays([*batch.select(cols).columns, pa.array(one)], [*cols, "h1"])

    return run


def _strip_rows(keep: list[str], names: list[str]):
    inner = _strip(keep, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = [None if r is None else [(x["first"], x["last"]) for x in r] for r in batch.column("removal").to_pylist()]
                at = batch.schema.get_field_index("removal")
                flat = pa.array(spans, pa.list_(pa.list_(pa.int32())))
                yield batch.set_column(at, "removal", flat)

        yield from inner(plain())

    return run


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), ["doc_id"], ["n_words", "n_removed", "kept_sha256"])


ORACLE_SQL = r"""
with split as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
windows as (
  select doc_id, unnest(range(1, len(w) - 48)) as i, w from split where len(w) >= 50),
keyed as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as k from windows),
least as (select k, min(doc_id) as lo from keyed group by k having min(doc_id) < max(doc_id)),
repeated as (select doc_id, list(i) as places from keyed join least using (k) where doc_id > lo group by doc_id),
covered as (
  select doc_id, list_distinct(flatten(list_transform(places, lambda p: range(p, p + 50)))) as gone from repeated),
kept as (
  select s.doc_id, len(w) as n, coalesce(len(gone), 0) as r,
    case when gone is null then w else (
      select list(w[j] order by j) from (select unnest(range(1, len(w) + 1)) as j) where not list_contains(gone, j)) end as words
  from split s left join covered using (doc_id))
select doc_id, n::bigint as n_words, r::bigint as n_removed, sha256(coalesce(array_to_string(words, ' '), '')) as kept_sha256 from kept"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLE = {"op4_substring_dedup": ORACLE_SQL}
