"""LM scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the background corpus, share one vocabulary: the pieces of a published
tokenizer and an end mark. Both have the same form, ``0.7 * pair share + 0.3 * smoothed piece share``, with exact counts
of pairs, and the background's counts are scaled to the target's total, so that smoothing weighs the same. A document's
score is the mean over its tokens of the target loss less the background loss: the lower, the more it is like the target.

All documents are counted. Texts are encoded in blocks of about a million tokens; a block sends each of its distinct
pairs once with its count. The summed counts are a written table that grows with the corpus; the blocks' distinct pairs
meet it in a join and return to their block, whose kept ids then take their losses. Only piece counts, of which there
are as many as the vocabulary has pieces, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels, vocabulary
from .common import Sieve, documents, short_batches, written

PIECES, CELLS, BLOCK = 1 << 16, 1 << 20, 1 << 20
END, SHARE = PIECES - 1, 0.7


def cells(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of pairs, for small tables of brute force; the operator itself never merges pairs."""
    pair = (before.astype(np.uint64) << np.uint64(16)) | after.astype(np.uint64)
    return (kernels.mix(pair) >> np.uint64(44)).astype(np.int64)


def codes(ids: np.ndarray) -> np.ndarray:
    """Each pair of neighbours as one number: the former piece above the latter."""
    return (ids[:-1].astype(np.uint32) << np.uint32(16)) | ids[1:]


_BLOCK = "block long, doc_ids array<long>, n_tokens array<long>, ids binary, pairs binary, times binary"


def blocks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encoded texts of docs (doc_id, text), a row a block: doc_ids and n_tokens of its texts, ids (16 bits each, with an
    end mark before, between and after texts; compressed), and the distinct pairs (32 bits) with their counts (64 bits)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, number = vocabulary.opened(tokenizer), TaskContext.get().partitionId(), 0
        mark, press = np.array([END], np.uint16), zstandard.ZstdCompressor(level=3)

        def block(doc_ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
            ids = np.concatenate([mark] + [x for own in parts for x in (own, mark)])
            pairs, times = np.unique(codes(ids), return_counts=True)
            n = pa.array([[len(own) for own in parts]], pa.list_(pa.int64()))
            bodies = [pa.array([x], pa.binary()) for x in (press.compress(ids.tobytes()), pairs.tobytes(), times.astype(np.int64).tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number]), pa.array([doc_ids], pa.list_(pa.int64())), n, *bodies], ["block", "doc_ids", "n_tokens", "ids", "pairs", "times"])

        doc_ids, parts, size = [], [], 0
        for batch in kernels.chunks(batches, "text", table=True):
            doc_ids += batch.column("doc_id").to_pylist()
            own = [words.encode(t) for t in batch.column("text").to_pylist()]
            parts += own
            size += sum(map(len, own)) + len(own)
            if size >= BLOCK:
                yield block(doc_ids, parts)
                doc_ids, parts, size, number = [], [], 0, number + 1
        if parts:
            yield block(doc_ids, parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, _BLOCK)


def pairs(made: DataFrame) -> DataFrame:
    """(block, pair, n): the distinct pairs of each block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pair, times in zip(*(batch.column(k) for k in ("block", "pairs", "times"))):
                pair, n = np.frombuffer(pair.as_py(), np.uint32).astype(np.int64), np.frombuffer(times.as_py(), np.int64)
                for k in range(0, len(pair), 1 << 16):
                    part = pair[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block.as_py())), pa.array(part), pa.array(n[k : k + (1 << 16)])], ["block", "pair", "n"])

    return made.select("block", "pairs", "times").mapInArrow(kernels.released(rows), "block long, pair long, n long")


def counts(target: DataFrame, background: DataFrame) -> DataFrame:
    """(pair, target, background): how often each pair stands in the blocks of the two, as a written table."""
    zero = F.lit(0).cast("long")
    both = pairs(target).select("pair", F.col("n").alias("target"), zero.alias("background"))
    both = both.unionAll(pairs(background).select("pair", zero.alias("target"), F.col("n").alias("background")))
    return written(both.groupBy("pair").agg(F.sum("target").alias("target"), F.sum("background").alias("background")), "pair-counts")


def model(pieces: np.ndarray, scale: float, vocabulary_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(0.3 * smoothed piece shares, 0.7 / piece counts): with pair counts, a probability is read from them."""
    one = pieces * scale
    share = (one + 1) / (one.sum() + vocabulary_size)
    return (1 - SHARE) * share, np.divide(SHARE, pieces, out=np.zeros(PIECES), where=pieces > 0)


def losses(tables: tuple[np.ndarray, ...], pair: np.ndarray, n: np.ndarray) -> np.ndarray:
    piece, per = tables
    return -np.log(n * per[pair >> 16] + piece[pair & 0xFFFF])


def score(docs: DataFrame, target: DataFrame, background: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of docs; losses are nats a token, the end
    mark counted as one.

    docs needs doc_id and text; target and background need text. Null and empty texts score their end mark alone.
    Repeated rows score alike and count each. An empty target or background is a uniform model. A background that is
    docs itself isn't encoded again.
    """
    spark = docs.sparkSession
    short_batches(spark)
    own = written(blocks(docs, tokenizer), "token-blocks")
    unnamed = lambda df: written(blocks(df.select(F.lit(None).alias("doc_id"), "text"), tokenizer).select("block", "pairs", "times"), "pair-blocks")
    table = counts(unnamed(target), own if background is docs else unnamed(background))
    pieces = np.zeros((2, PIECES))
    for piece, t, b in table.groupBy(F.col("pair").bitwiseAND(F.lit(0xFFFF)).alias("piece")).agg(F.sum("target"), F.sum("background")).collect():
        pieces[:, piece] = t, b
    size = vocabulary.Vocabulary(tokenizer).tokenizer.get_vocab_size() + 1
    t1, b1 = pieces
    scale = float(t1.sum() / b1.sum()) if t1.sum() and b1.sum() else 1.0
    tables = spark.sparkContext.broadcast((model(t1, 1.0, size), model(b1, scale, size)))

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        pair = known.column("pair").to_numpy()
        order = np.argsort(pair)
        pair = pair[order]
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(block.column("ids")[0].as_py()), np.uint16)
        at = np.searchsorted(pair.astype(np.uint32), codes(ids))
        n = block.column("n_tokens").combine_chunks().flatten().to_numpy()
        cut = np.cumsum(n + 1) - n - 1
        own = zip(tables.value, ("target", "background"))
        target_loss, background_loss = (np.add.reduceat(losses(t, pair, known.column(k).to_numpy()[order])[at], cut) / (n + 1) for t, k in own)
        kernels.give_back()
        doc_ids = block.column("doc_ids").combine_chunks().flatten()
        return pa.table([doc_ids, pa.array(n), pa.array(target_loss), pa.array(background_loss), pa.array(target_loss - background_loss)], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    zero = F.lit(0).cast("long")
    known = pairs(own).select("block", "pair").join(table.hint("merge"), "pair", "left").select(
        "block", "pair", F.coalesce("target", zero).alias("target"), F.coalesce("background", zero).alias("background")
    )
    bodies = own.select("block", "doc_ids", "n_tokens", "ids")
    return bodies.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: all documents labelled as of good quality; background: all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    target = Sieve(good, "doc_id").passing(docs, "doc_id").join(good, "doc_id", "left_semi")
    return score(docs, target, docs, vocabulary.default_path())


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
ORACLE: dict[str, str] = {}
