"""All detectors over a source in one pass.

The relational operators (literals, words, shapes, key text) each read the sources for themselves and let Spark join what
they find; this operator is for scans in bulk: a source's bytes go through Arrow once, all detectors look at them there,
and weaker evidence is dropped beside stronger one within the source, so that the plan is a scan and a projection and no
byte of a source is ever shuffled. What a report needs from around a hit, its line's fingerprint and its carve, is cut in
the same step. Both ways give the same detections; tests hold one against the other.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import keys
from ..model import BLOCK, ScanOptions
from . import shapes, words

SCHEMA = (
    "target string, needle string, offset bigint, match_length int, block_offset bigint, verified boolean, gaps array<int>, typos array<int>,"
    "validating array<int>, words array<string>, fingerprint string, carve binary"
)
MOST_UNKNOWN, MOST_TRIED = 2, 64
_BASE58 = np.zeros(256, bool)
_BASE58[list(b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz")] = True


class WordList:
    """A word list of 1,024 to 2,048 words of 3 to 8 letters, looked up by numbers made of their letters."""

    def __init__(self, listed: list[str]):
        self.words = listed
        numbers = np.array([int.from_bytes(w.encode().ljust(8, b"\0"), "little") for w in listed], np.uint64)
        self.order = np.argsort(numbers)
        self.numbers = numbers[self.order]
        self.by_rest: dict[str, list[int]] = {}
        for i, w in enumerate(listed):
            for key in words.deletions(w):
                self.by_rest.setdefault(key, []).append(i)

    def places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number in the list of each token of lower-case data, -1 if it isn't in it."""
        size = end - start
        out = np.full(len(start), -1, np.int64)
        fits = np.flatnonzero((size >= 3) & (size <= 8))
        if not len(fits) or not len(self.words):
            return out
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        letters = padded[start[fits, None] + np.arange(8)]
        letters[np.arange(8) >= size[fits, None]] = 0
        number = np.ascontiguousarray(letters).view("<u8").ravel()
        at = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
        out[fits] = np.where(self.numbers[at] == number, self.order[at], -1)
        return out

    def near(self, token: str) -> list[int]:
        """Listed words within two edits of a token, in the list's order."""
        if len(token) > 10:
            return []
        found = {i for key in words.deletions(token) for i in self.by_rest.get(key, ())}
        return sorted(i for i in found if _within_two(token, self.words[i]))


def _within_two(a: str, b: str) -> bool:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] <= 2


def checksum_holds(ixs: list[int]) -> bool:
    """The SHA-256 checksum of 11-bit numbers, as many bits as a third of the words."""
    check = len(ixs) // 3
    bits = 0
    for i in ixs:
        bits = bits << 11 | i
    entropy = (bits >> check).to_bytes((len(ixs) * 11 - check) // 8)
    return hashlib.sha256(entropy).digest()[0] >> 8 - check == bits & (1 << check) - 1


def share_holds(ixs: list[int]) -> bool:
    """The rules of a share: its threshold and the 30-bit checksum over the customization that its flag selects."""
    if (ixs[2] >> 2 & 15) > ((ixs[2] & 3) << 2 | ixs[3] >> 8):
        return False
    c = 1
    for v in [*(b"shamir_extendable" if ixs[1] >> 4 & 1 else b"shamir"), *ixs]:
        top, c = c >> 20, (c & 0xFFFFF) << 10 ^ v
        for i, g in enumerate(words.SHARE_GENERATORS):
            c ^= g if top >> i & 1 else 0
    return c == 1


def versioned(phrase: str) -> bool:
    return hmac.new(b"Seed version", phrase.encode(), "sha512").hexdigest().startswith(tuple(words.VERSION_PREFIXES))


def _runs(valid: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], valid, [False]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def word_evidence(data: bytes, seeds: WordList, shares: WordList) -> list[dict]:
    """Seeds, versioned seeds, shares, unordered runs and near misses of one source, the weaker dropped beside the stronger:
    a versioned seed inside a longer seed; a run that holds any of them; a window whose listed words all lie in one seed,
    that is a run with overhang, or that touches a reported run."""
    low = np.frombuffer(data.lower(), np.uint8)
    start, end = words.letter_runs(data)
    ixs = seeds.places(low, start, end)
    out: list[dict] = []

    def add(needle: str, a: int, b: int, **more: object) -> tuple[int, int]:
        spoken = [data[x:y].decode().lower() for x, y in zip(start[a:b].tolist(), end[a:b].tolist())]
        out.append({"needle": needle, "offset": int(start[a]), "match_length": int(end[b - 1] - start[a]), "words": spoken, **more})
        return a, b

    span = lambda a, n: end[a + n - 1] - start[a]
    runs = [r for r in _runs(ixs >= 0) if r[1] - r[0] >= words.SEED_LENGTHS[0]]
    exact = [add(f"bip39-{n}", i, i + n) for a, b in runs for i in range(a, b) for n in words.SEED_LENGTHS if i + n <= b and span(i, n) <= words.MAX_SPAN and checksum_holds(ixs[i : i + n].tolist())]
    own = [(i, i + 12) for a, b in runs for i in range(a, b - 11) if versioned(" ".join(seeds.words[k] for k in ixs[i : i + 12].tolist()))]
    other = [add("electrum-seed", a, b) for a, b in own if not any(x <= a and b <= y and y - x > 12 for x, y in exact)]
    numbers = shares.places(low, start, end) if len(start) >= words.SHARE_LENGTHS[0] else ixs
    for a, b in [r for r in _runs(numbers >= 0) if r[1] - r[0] >= words.SHARE_LENGTHS[0]]:
        other += [add(f"slip39-{n}", i, i + n) for i in range(a, b) for n in words.SHARE_LENGTHS if i + n <= b and share_holds(numbers[i : i + n].tolist())]
    loose = [add("bip39-unordered", a, b) for a, b in runs if not any(a <= x and y <= b for x, y in exact + other)]

    unknown = np.concatenate([[0], np.cumsum(ixs < 0)])
    least = words.SEED_LENGTHS[0]
    if len(ixs) < least or (unknown[least:] - unknown[:-least]).min() > MOST_UNKNOWN:
        return out  # a longer window with so few unknown words would hold such a window of the least length
    seen: set[tuple] = set()
    for n in words.SEED_LENGTHS:
        if len(start) < n:
            break
        missing = unknown[n:] - unknown[:-n]
        for i in np.flatnonzero((missing > 0) & (missing <= MOST_UNKNOWN) & (end[n - 1 :] - start[: len(start) - n + 1] <= words.MAX_SPAN)).tolist():
            gaps = [k for k in range(n) if ixs[i + k] < 0]
            inside = [k for k in range(i, i + n) if ixs[k] >= 0]
            overhang = gaps[0] == 0 and i + n < len(ixs) and ixs[i + n] >= 0 or gaps[-1] == n - 1 and i > 0 and ixs[i - 1] >= 0
            if overhang or any(x <= inside[0] and inside[-1] < y for x, y in exact) or any(i < y and x < i + n for x, y in loose):
                continue
            if (key := (n, *(i + g for g in gaps))) in seen:
                continue
            seen.add(key)
            near = [seeds.near(data[start[i + g] : end[i + g]].decode().lower()) for g in gaps]
            add(f"bip39-{n}-near-miss", i, i + n, gaps=gaps, typos=[len(x) for x in near], validating=_validating(ixs[i : i + n].tolist(), gaps, near))
    return out


def _validating(ixs: list[int], gaps: list[int], near: list[list[int]]) -> list[int]:
    """How many candidates of each gap complete the window to a valid one, with any candidate of the other gap; of a gap's
    candidates the first MOST_TRIED are tried, which is the rule's own bound."""
    good: list[set[int]] = [set() for _ in gaps]

    def fill(k: int, chosen: list[int]) -> None:
        if k == len(gaps):
            if checksum_holds(ixs):
                for s, c in zip(good, chosen):
                    s.add(c)
            return
        for c in near[k][:MOST_TRIED]:
            ixs[gaps[k]] = c
            fill(k + 1, [*chosen, c])

    ixs = list(ixs)
    fill(0, [])
    return [len(s) for s in good]


_LINE_SHAPES = {
    "electrum-file": ([b'"seed_version"'], re.compile(shapes.ELECTRUM_FILE.encode())),
    "aws-access-key": ([b"AKIA"], re.compile(shapes.ACCESS_KEY.encode(), re.A)),
    "github-token": ([b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"], re.compile(shapes.TOKEN.encode(), re.A)),
    "pem-private-key": ([b" PRIVATE KEY-----", b"BEGIN PRIVATE KEY-----"], re.compile(shapes.PEM.encode())),
}


def _der_fits(body: bytes) -> bool:
    if len(body) < 2 or body[0] != 0x30:
        return False
    n = body[1] & 127 if body[1] & 128 else 0
    return n <= 2 and len(body) == 2 + n + (int.from_bytes(body[2 : 2 + n]) if n else body[1])


def shape_evidence(data: bytes, profile: str) -> list[dict]:
    out = [{"needle": "metamask-vault", "offset": a, "match_length": b - a} for a, b in shapes.vault_spans(data)] if b"iv" in data else []
    for needle, (anchors, pattern) in _LINE_SHAPES.items():
        if needle != "electrum-file" and profile != "secrets" or not any(a in data for a in anchors):
            continue
        for m in pattern.finditer(data):
            more = {}
            if needle == "pem-private-key":
                body = shapes.decoded(re.sub(rb"\s", b"", m[2]))
                if not body or len(body) < 2 or not (_der_fits(body) or b"OPENSSH" in m[1]):
                    continue
                more = {"verified": _der_fits(body)}
            out.append({"needle": needle, "offset": m.start(), "match_length": m.end() - m.start(), **more})
    if b'"ciphertext"' in data:
        for at, text in shapes.enclosing_objects(data.decode("latin-1")):
            if shapes.usable_keystore(text):
                out.append({"needle": "eth-keystore", "offset": at, "match_length": len(text)})
    if b")#" in data:
        out += [{"needle": "descriptor", "offset": a, "match_length": n} for a, n in shapes.descriptor_spans(data.decode("latin-1"))]
    at = data.find(b"\x08", 49)
    while at >= 0:
        head = at - 49
        if data[head : head + 1] == b"0" and data[at + 9 : at + 13] == bytes(4) and head + 66 <= len(data) and 1000 <= struct.unpack_from("<I", data, head + 62)[0] <= 100_000_000:
            out.append({"needle": "mkey", "offset": head, "match_length": 66})
        at = data.find(b"\x08", at + 1)
    return out


def key_evidence(data: bytes) -> list[dict]:
    """Checksummed keys at any position in runs of 51 and more base58 characters."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _BASE58[raw], [False]])))
    out = []
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        for i in range(a, b - 50) if b - a >= 51 else ():
            first = data[i : i + 1]
            sizes = (52, 51) if first in (b"5", b"K", b"L", b"9", b"c") else (111,) if first in b"xyztuv" and data[i + 1 : i + 4] in (b"prv", b"pub") else ()
            for n in sizes:
                if i + n <= b and (kind := keys.key_label(data[i : i + n].decode())):
                    out.append({"needle": kind, "offset": i, "match_length": n})
                    break
    return out


def scan_all(sources: DataFrame, needles: list[str], seeds: list[str], options: ScanOptions = ScanOptions(), carve: bool = False) -> DataFrame:
    """Every detection of every source (target, data): SCHEMA. Matched words come only with options.reveal, carves only if
    asked for; the credentials profile only if options name it. Null data has none; repeated rows repeat theirs. The word
    list is that of seeds; shares use its first 1,024 words."""
    if len(seeds) > 2048:
        raise ValueError("a word list has at most 2,048 words")
    literal = [(n, n.encode()) for n in needles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, short = WordList(seeds), WordList(seeds[:1024])
        for batch in batches:
            rows = []
            for target, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = data or b""
                own = data[options.start_offset :] if options.start_offset else data
                found = []
                for name, needle in literal:
                    at = own.find(needle)
                    while at >= 0:
                        found.append({"needle": name, "offset": at, "match_length": len(needle)})
                        at = own.find(needle, at + len(needle))
                found += word_evidence(own, full, short) + shape_evidence(own, options.profile) + key_evidence(own)
                for hit in found:
                    a, n = hit["offset"], hit["match_length"]
                    begin = own.rfind(b"\n", max(0, a - 4096), a + 1) + 1 or max(0, a - 4096)
                    stop = own.find(b"\n", a + n, a + n + 8192)
                    line = own[begin : stop if stop >= 0 else a + n + 8192]
                    hit |= {"target": target, "offset": a + options.start_offset, "block_offset": (a + n - 1) // BLOCK * BLOCK + options.start_offset}
                    hit["fingerprint"] = f"v1/{target}/{hit['needle']}/{hashlib.sha256(line).hexdigest()[:16]}"
                    if not options.reveal:
                        hit.pop("words", None)
                    if carve:
                        hit["carve"] = own[max(0, a - options.context_bytes) : a + n + options.context_bytes]
                rows += found
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return sources.select("target", "data").mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [("target", pa.string()), ("needle", pa.string()), ("offset", pa.int64()), ("match_length", pa.int32()), ("block_offset", pa.int64()), ("verified", pa.bool_())]
    + [(c, pa.list_(pa.int32())) for c in ("gaps", "typos", "validating")]
    + [("words", pa.list_(pa.string())), ("fingerprint", pa.string()), ("carve", pa.binary())]
)
