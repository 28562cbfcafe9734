"""BPE encoding and decoding through a table of distinct words.

1. Words (the pre-tokenizer's pieces) are split in one scan. A block of documents becomes a row: its distinct words, and
   for each document the positions of its words among them, compressed. The blocks are a written table.
2. The blocks' words are dealt out by word, exploded and sorted, so that equal words stand together: each distinct word of
   the corpus becomes one row, encoded once, with the blocks and positions that hold it. Its ids are joined with the
   vocabulary's pieces, which gives what the word decodes to.
3. What a task has found for a block returns to it as one packed row and meets the block's positions, which put ids and
   decoded pieces in the order of the texts.

A word is a row once a block, however often it stands there. Nothing holds a group that grows with the input: a task
streams words, or holds one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels, vocabulary
from .common import documents, short_batches, written

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_BLOCK = "block long, doc_ids array<long>, n_words array<long>, places binary, words array<binary>"


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane: of small ones most planes are empty."""
    return b"".join((numbers >> 8 * k & 255).astype("u1").tobytes() for k in range(4))


def _from_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, "u1").reshape(4, -1)
    return sum(planes[k].astype(np.int64) << 8 * k for k in range(4))


def _press(places: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(_planes(places))


def _unpress(body: bytes) -> np.ndarray:
    return _from_planes(zstandard.ZstdDecompressor().decompress(body))


def split_words(docs: DataFrame, tokenizer: str, text_bytes: int, most_words: int) -> DataFrame:
    """The blocks of docs (doc_id, text): of text_bytes and a text, or of most_words distinct words and those of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.opened(tokenizer)
        task, block, held = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        number: dict[str, int] = {}
        lists: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, held, number
            at = np.concatenate([np.zeros(0, "<u4"), *lists])
            order = np.argsort(-np.bincount(at, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            known = list(number)
            words = [known[i].encode("utf-8", "surrogateescape") for i in order.tolist()]
            cols = [[task << 32 | block], [docs], [[len(x) for x in lists]], [_press(rank[at])], [words]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["block", "doc_ids", "n_words", "places", "words"])
            docs.clear()
            lists.clear()
            block, held, number = block + 1, 0, {}
            return out

        for batch in kernels.chunks(batches, "text", table=True):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = vocab.words(text)
                docs.append(doc)
                lists.append(np.fromiter((number.setdefault(w, len(number)) for w in found), "<u4", len(found)))
                held += len(text or "")
                if held >= text_bytes or len(number) >= most_words:
                    yield flush()
        if docs:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def _runs(column: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)]]) if len(column) else np.zeros(1, np.int64)


def dealt_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, place, word) of the blocks' words, those of one hash in one partition. They travel as a packed row a block and
    bucket, as rows of their own are three times as large."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words")):
                words = words.values.to_pylist()
                of = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
                order = np.argsort(of, kind="stable")
                cut = _runs(of[order]).tolist()
                bodies = [_pack(order[a:b], [(words[i], b"") for i in order[a:b].tolist()]) for a, b in zip(cut, cut[1:])]
                own = pa.array(of[order][cut[:-1]] if len(order) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(bodies), block)), pa.array(bodies, pa.binary())], ["bucket", "block", "body"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist()):
                places, words, _ = _unpack(body)
                for k in range(0, len(words), 1 << 14):
                    part = words[k : k + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(places[k : k + len(part)].astype(np.int32)), pa.array(part, pa.binary())], ["block", "place", "word"])

    packed = blocks.select("block", "words").mapInArrow(spread, "bucket long, block long, body binary")
    return packed.repartition("bucket").select("block", "body").mapInArrow(opened, "block long, place int, word binary")


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """The distinct-word table of (block, place, word), word in binary, dealt out by word: blocks, places and ids of each
    distinct word. A word whose rows an Arrow batch cuts comes twice, but is encoded once."""
    dealt = words.select("block", "place", "word").sortWithinPartitions("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.opened(tokenizer)
        last, ids = None, np.zeros(0, np.int32)
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            cut, known, out = _runs(coded.indices.to_numpy()), coded.dictionary.to_pylist(), []
            for i in coded.indices.to_numpy()[cut[:-1]].tolist():
                if known[i] != last:
                    last, ids = known[i], np.frombuffer(vocab.encode_word(known[i].decode("utf-8", "surrogateescape")), "<u2").astype(np.int32)
                out.append(ids)
            ends = np.concatenate([[0], np.cumsum(list(map(len, out)))]).astype(np.int32)
            edges = pa.array(cut.astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, batch.column(c)) for c in ("block", "place")]
            yield pa.RecordBatch.from_arrays([*lists, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))], ["blocks", "places", "ids"])

    return dealt.mapInArrow(run, "blocks array<long>, places array<int>, ids array<int>")


def with_pieces(table: DataFrame, tokenizer: str) -> DataFrame:
    """(block, body): what a task knows of a block's words, packed. Each word's ids are joined with the vocabulary's pieces
    (at most 65,536, the side that is broadcast); the join streams, so that a word's pieces come one after another."""
    pieces = table.sparkSession.createDataFrame(list(enumerate(vocabulary.Vocabulary(tokenizer).pieces())), "id int, piece string")
    rows = table.withColumn("row", F.monotonically_increasing_id()).select("row", "blocks", "places", F.posexplode_outer("ids").alias("at", "id"))
    rows = rows.select("row", "id", *[F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).alias(c) for c in ("blocks", "places")])
    joined = rows.join(F.broadcast(pieces), "id", "left").select("row", "id", "piece", "blocks", "places")

    def run(batches: Iterator[pa.RecordBatch], room: int = 1 << 18) -> Iterator[pa.RecordBatch]:
        words: list[tuple[bytes, bytes]] = []  # ids, decoded text
        blocks, places, number, held = [], [], [], 0
        kept: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            nonlocal held
            block, place, word = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (blocks, places, number))
            order = np.lexsort((place, block))
            cut = _runs(block[order])
            bodies = [_pack(place[own], [words[w] for w in word[own].tolist()]) for own in (order[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist()))]
            out = pa.RecordBatch.from_arrays([pa.array(block[order][cut[:-1]]), pa.array(bodies, pa.binary())], ["block", "body"])
            for x in (words, blocks, places, number):
                x.clear()
            held = 0
            return out

        def take(batch: pa.RecordBatch) -> None:
            nonlocal held
            cut = _runs(batch.column("row").to_numpy()).tolist()
            ids = batch.column("id").fill_null(0).to_numpy().astype("<u2")
            said, empty = batch.column("piece").to_pylist(), batch.column("id").is_null().to_pylist()
            own_blocks, own_places = (batch.column(c).take(pa.array(cut[:-1])) for c in ("blocks", "places"))
            sizes = np.diff(own_blocks.offsets.to_numpy())
            blocks.append(own_blocks.flatten().to_numpy())
            places.append(own_places.flatten().to_numpy().astype(np.int64))
            number.append(np.repeat(np.arange(len(words), len(words) + len(sizes)), sizes))
            words.extend((b"", b"") if empty[a] else (ids[a:b].tobytes(), " ".join([x or "" for x in said[a:b]]).encode("utf-8", "surrogatepass")) for a, b in zip(cut, cut[1:]))
            held += int(sizes.sum())

        for batch in batches:
            if not batch.num_rows:
                continue
            if kept:
                batch = pa.concat_batches([*kept, batch])
            last = int(_runs(batch.column("row").to_numpy())[-2])  # the last word may go on in the next batch
            kept = [batch.slice(last)]
            if last:
                take(batch.slice(0, last))
            if held >= room:
                yield packed()
        if kept:
            take(kept[0])
        if held:
            yield packed()
        kernels.give_back()

    return joined.mapInArrow(run, "block long, body binary")


def _pack(places: np.ndarray, words: list[tuple[bytes, bytes]]) -> bytes:
    """Places in ascending order, kept as steps, and two byte strings for each."""
    sizes = [np.fromiter((len(w[k]) for w in words), "<u4", len(words)) for k in (0, 1)]
    raw = [np.uint32(len(words)).tobytes(), *map(_planes, (np.diff(places, prepend=0), *sizes)), *[w[0] for w in words], *[w[1] for w in words]]
    return zstandard.ZstdCompressor(level=6).compress(b"".join(raw))


def _unpack(body: bytes) -> tuple[np.ndarray, list[bytes], list[str]]:
    """(places, first byte strings, the others as texts)."""
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    steps, *sizes = (_from_planes(raw[4 + 4 * n * k : 4 + 4 * n * (k + 1)]) for k in range(3))
    at = 4 + 12 * n
    ends = (at + np.cumsum(np.concatenate(sizes))).tolist()
    starts = [at, *ends[:-1]] if n else []
    parts = [raw[a:b] for a, b in zip(starts, ends)]
    return np.cumsum(steps), parts[:n], [x.decode("utf-8", "surrogatepass") for x in parts[n:]]


def decode(ids: DataFrame, tokenizer: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """key, decoded: the texts of given id lists, by a join of ids with the vocabulary's pieces and a regrouping.

    Null or empty lists decode to the empty text; ids outside the vocabulary decode to nothing. Repeated keys keep a
    row each. The vocabulary, at most 65,536 pieces by the check in Vocabulary, is the side that is broadcast.
    """
    pieces = ids.sparkSession.createDataFrame(list(enumerate(vocabulary.Vocabulary(tokenizer).pieces())), "id int, piece string")
    rows = ids.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(column).alias("list"))
    each = rows.select("row", "key", F.posexplode_outer("list").alias("at", "id")).join(F.broadcast(pieces), "id", "left")
    own = F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece"))))
    return each.groupBy("row", "key").agg(own.alias("said")).select(F.col("key").alias(key), F.array_join("said.piece", " ").alias("decoded"))


def encode_decode(docs: DataFrame, tokenizer: str, text_bytes: int = 32 << 20, most_words: int = 400_000, with_output: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if with_output) of every row of docs.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have no token. Repeated rows and null
    ids each keep a row. A text of any length stays in one block. docs is read once. An empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    blocks = written(split_words(docs, tokenizer, text_bytes, most_words), "word-blocks", "zstd")
    words = dealt_words(blocks, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = with_pieces(encode_words(words, tokenizer), tokenizer).withColumnRenamed("block", "of")

    def join(block: pa.Table, known: pa.Table) -> pa.Table:
        at, end, out = _unpress(block.column("places")[0].as_py()), 0, []
        total = int(at.max(initial=-1)) + 1
        digits, decoded, n, found = [""] * total, [""] * total, np.zeros(total, np.int64), 0
        for body in known.column("body").to_pylist():
            for place, ids, said in zip(*(x if isinstance(x, list) else x.tolist() for x in _unpack(body))):
                numbers = np.frombuffer(ids, "<u2").tolist()
                digits[place], decoded[place], n[place] = " ".join(map(str, numbers)), said, len(numbers)
                found += 1
        if found != total:
            raise ValueError("a block's words are not all in the word table")
        for words in block.column("n_words")[0].as_py():
            own = at[end : end + words]
            end += words
            size = n[own]
            own = own[size > 0].tolist()
            numbers, said = " ".join([digits[i] for i in own]), " ".join([decoded[i] for i in own])
            row = int(size.sum()), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(said.encode("utf-8", "replace")).hexdigest()
            out.append(row + (([int(i) for i in numbers.split()], said) if with_output else ()))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
        kernels.give_back()
        return pa.table([pa.array(block.column("doc_ids")[0].as_py(), pa.int64()), *columns], ["doc_id", *names[: len(columns)]])

    schema = RESULT + (", ids array<int>, decoded string" if with_output else "")
    bodies = blocks.select("block", "doc_ids", "n_words", "places")
    return bodies.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(join, schema)


def op6_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), vocabulary.default_path())


QUERIES = {"op6_bpe_words": op6_bpe_words}
ORACLE: dict[str, str] = {}
