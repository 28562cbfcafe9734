"""Cost-balanced packing of documents into token sequences.

A piece of n tokens costs ``linear * n + quadratic * n**2``: the part of a training step that grows with tokens and the
attention within the piece. Within a group of pieces there are as many sequences as their tokens need; pieces go in
descending order, each to the sequence of least cost so far that still has room. A piece that fits nowhere is cut so
that it fills the roomiest sequence and its rest goes on; so a group leaves less than one sequence of padding in all.

Groups are runs of documents of one input partition, up to a stated number of tokens: no shuffle, no state that grows
with the input, and a lost task is simply run again with the same result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import kernels, vocabulary
from .common import documents, short_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plan_group(sizes: np.ndarray, room: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given sizes; every token lies in one piece.

    Empty documents have no piece. Equal sizes keep their order; of equal costs the lower sequence wins.
    """
    total = int(sizes.sum())
    if not total:
        return []
    # pieces that fill a sequence come first and take one each, in order; the rest share the sequences after them
    out = [(d, start, room) for d, n in enumerate(sizes.tolist()) for start in range(0, n - room + 1, room)]
    out = [(d, start, n, s, 0) for s, (d, start, n) in enumerate(out)]
    full, count = len(out), -(-total // room)
    cost, free = np.zeros(count - full), np.full(count - full, room, np.int64)
    queue = [(-(n % room), d, n - n % room) for d, n in enumerate(sizes.tolist()) if n % room]
    heapq.heapify(queue)
    while queue:
        n, d, start = heapq.heappop(queue)
        n = -n
        fits = np.flatnonzero(free >= n)
        if len(fits):
            s = int(fits[np.argmin(cost[fits])])
            part = n
        else:
            s = int(np.argmax(free))
            part = int(free[s])
            heapq.heappush(queue, (-(n - part), d, start + part))
        out.append((d, start, part, full + s, room - int(free[s])))
        free[s] -= part
        cost[s] += linear * part + quadratic * part * part
    return out


def pack(docs: DataFrame, tokenizer: str, room: int = 2048, end_id: int = 1, group_tokens: int = 1 << 20, with_ids: bool = False, most_words: int = 400_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if with_ids).

    docs needs doc_id and text; other columns, of any name, are ignored. Null or empty text is a document of the end
    id alone. Repeated rows are separate documents; a null doc_id stays null. A text of any length is cut at need.
    An empty table gives an empty result. Sequence ids are unique over the table: input partition and number within.
    """
    short_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.opened(tokenizer, most_words)
        base, held, ids_of, doc_of = TaskContext.get().partitionId() << 33, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            sizes = np.fromiter(map(len, ids_of), np.int64, len(ids_of))
            plan = plan_group(sizes, room)
            d, start, length, s, offset = (np.array(x, np.int64) for x in zip(*plan)) if plan else [np.zeros(0, np.int64)] * 5
            cut = [ids_of[a][b : b + n].astype("<u4") for a, b, n in zip(d.tolist(), start.tolist(), length.tolist())]
            out = {
                "doc_id": pa.array(doc_of, pa.int64()).take(pa.array(d)),
                "start": start, "length": length, "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()),
                "doc_tokens": sizes[d], "sequence_id": s + base, "offset": offset,
            }
            if with_ids:
                out["ids"] = pa.array([x.tolist() for x in cut], pa.list_(pa.int32()))
            base += int(s.max()) + 1 if len(s) else 0
            held = 0
            ids_of.clear()
            doc_of.clear()
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], list(out))

        for batch in kernels.chunks(batches, "text", table=True):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids_of.append(np.append(words.encode(text), np.uint16(end_id)))
                doc_of.append(doc)
                held += len(ids_of[-1])
                if held >= group_tokens:
                    yield flush()
        if ids_of:
            yield flush()

    return rows.mapInArrow(packed, SCHEMA + (", ids array<int>" if with_ids else ""))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary.default_path())


QUERIES = {"op1_packing": op1_packing}
ORACLE: dict[str, str] = {}
