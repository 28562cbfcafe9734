"""Array kernels shared by the text operators: words and their hashes for a whole Arrow batch at once.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D of a text's UTF-8 form. A word's hash is a
cryptographic digest, computed once for each distinct word of a batch, so that no text can be made whose words collide.
Windows are hashed by Rabin-Karp polynomials over word hashes modulo the prime 2**61 - 1 at a random base, built by
doubling, so that a batch costs a fixed number of numpy passes over its words. Texts of any length are handled; null
counts as empty.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa

T = TypeVar("T")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PERSON = b"text operators"
PRIME = (1 << 61) - 1
_rng = np.random.Generator(np.random.PCG64(20240229))
BASES = tuple(int(x) for x in _rng.integers(1 << 59, PRIME - 1, 2))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of a splittable generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(raw: np.ndarray, at: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in raw, and the number of the first word of each text (with a final total).

    outside: which bytes are in no word, if not white space.
    """
    inside = ~outside[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0] = edge[-1] = False
    if len(raw):
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[0], inside[-1]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    both = cuts[inside[cuts - 1] & inside[cuts]] if len(raw) else cuts
    where = np.flatnonzero(edge)
    if len(both):  # a word may end where the text ends and the next text begin with a word
        where = np.sort(np.concatenate([where, np.unique(both).repeat(2)]))
    start, end = where[0::2], where[1::2]
    return start, end, np.searchsorted(start, at)


def digest(data: bytes) -> bytes:
    """128 bits of a cryptographic hash."""
    return hashlib.blake2b(data, digest_size=16, person=PERSON).digest()


def word_digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Two 64-bit halves of a 128-bit digest of each word, (words, 2); lower: A-Z count as a-z. start and end are
    those of all words, in order, so that their bytes lie one after another once the others are left out."""
    n = len(start)
    if not n:
        return np.zeros((0, 2), np.uint64)
    own = np.zeros(len(raw) + 1, np.int8)
    own[start] += 1
    own[end] -= 1
    own = raw[np.cumsum(own, dtype=np.int8)[:-1].view(bool)]
    if lower:
        own = _LOWER[own]
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    coded = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(own)]).dictionary_encode()
    _, at, data = coded.dictionary.buffers()
    at, data = np.frombuffer(at, np.int64, len(coded.dictionary) + 1).tolist(), data.to_pybytes()
    distinct = b"".join([digest(data[a:b]) for a, b in zip(at, at[1:])])
    return np.frombuffer(distinct, "<u8").reshape(-1, 2)[coded.indices.to_numpy()]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """The first half of each word's digest."""
    return word_digests(raw, start, end, lower)[:, 0]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(61))
    x -= p * (x >= p)
    return x


def times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo PRIME, for x below PRIME: from halves of 31 and 30 bits, as 2**61 counts as 1."""
    high, low, half = np.uint64(c >> 31), np.uint64(c & 0x7FFFFFFF), np.uint64(31)
    x1, x0 = x >> half, x & np.uint64(0x7FFFFFFF)
    middle = x1 * low + x0 * high
    return _reduced(((x1 * high) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64(0x3FFFFFFF)) << half) + x0 * low)


def polynomials(word: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """The Rabin-Karp polynomial, modulo PRIME, of each run of width word hashes (a row a run's start); a run of 2k words
    is one of k words and base**k times the one after it. Runs that cross a text's end are there too and must be masked."""
    if len(word) < width or not width:
        return np.zeros(0, np.uint64)
    base, one = BASES[which], _reduced(word)
    have, span = one, 1
    for bit in bin(width)[3:]:
        have = _reduced(have[:-span] + times(have[span:], pow(base, span, PRIME)))
        span *= 2
        if bit == "1":
            have = _reduced(have[: len(word) - span] + times(one[span:], pow(base, span, PRIME)))
            span += 1
    return have


def window_hashes(word: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """polynomials with every bit spread over 64 bits."""
    return mix(polynomials(word, width, which))


def window_owner(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, text) of all windows of width words that lie within one text."""
    counts = np.maximum(np.diff(first) - (width - 1), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    skip = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - skip[text] + first[:-1][text], text


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20, table: bool = False) -> Iterator[pa.RecordBatch]:
    """Cuts batches by bytes of text, so that what a kernel holds doesn't grow with rows a batch; one text stays whole.
    After the last one it gives freed memory back, as the worker process lives on. table: the caller uses keep_one;
    for any other, what an earlier operator has kept goes."""
    if not table:
        _kept.clear()
    yield from _cut(batches, text, limit)
    give_back()


_kept: dict[object, object] = {}


def keep_one(key: object, make: Callable[[], T]) -> T:
    """What a worker process keeps from task to task: one table of words at a time, whatever operators it has run."""
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker process gives its freed memory back, and keeps no table of an earlier operator."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _kept.clear()
        yield from run(batches)
        give_back()

    return own


def _cut(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(text)
        size = np.fromiter((0 if v is None else v for v in _lengths(column)), np.int64, len(column))
        cut = np.cumsum(size) // limit
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(column)] if len(column) else [0]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _lengths(column: pa.Array) -> list[int | None]:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()
