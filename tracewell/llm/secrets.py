"""Secret scans: patterns of known shape, and a battery of randomness tests for the rest.

Every run of encoded-looking characters is a candidate, or what a pattern of known shape leaves of it. Its encoding is
inferred from the characters it uses, and three tests ask whether it could be uniform random text of that encoding:
chi-squared uniformity of the alphabet, the number of runs about the middle code, and serial correlation; Fisher's method
combines them into the battery's p-value. A run that isn't random fails the battery, but a short one of a small alphabet
may pass it, so a candidate must also be unlike ordinary text: the likelihood ratio of uniform text against a
character-pair model of all documents bounds the chance that ordinary text looks so random (by Markov's inequality
``1 / ratio`` is a valid p-value at every length).

False discoveries are controlled over the whole corpus by Benjamini-Hochberg on both p-values, in classes of length, as
long runs are tested with more power than short ones. On the battery's p-values a discovery is a run that isn't random:
of those dismissed, at most the share `fair` may be random after all. On the second a discovery is a secret: of those
reported, at most the share `rate` may be ordinary text. Both are judged over distinct runs, so that copies of one run,
secret or not, don't move a threshold, and the pair model leaves all long runs out: a secret teaches it nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import documents, short_batches, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ["assign", "access", "hex", "random"]
CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
ENCODINGS = {  # from the smallest alphabet up; the first that covers a run is its encoding
    "decimal": "0123456789", "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "lower": CODES[26:52], "UPPER": CODES[:26], "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": CODES[:62], "base64": CODES[:64], "base64url": CODES[:62] + "-_", "any": CODES,
}
LENGTHS = [20, 32, 48, 96]  # lower ends of the classes of length
LEAST, HEX_LEAST, BINS, BIN = 20, 24, 800, 0.1

_symbol = np.full(256, len(CODES), np.int64)
_symbol[list(CODES.encode())] = np.arange(len(CODES))
_outside_code, _outside_hex = np.ones(256, bool), np.ones(256, bool)
_outside_code[list(CODES.encode())] = False
_outside_hex[list(b"0123456789abcdef")] = False
N = len(CODES) + 1


def pair_counts(docs: DataFrame) -> np.ndarray:
    """How often each pair of code characters (all other characters are one) stands side by side in the texts outside
    runs of LEAST and more code characters, which are candidates. A text's border counts as another character."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N * N, np.int64)
        for batch in kernels.chunks(batches, "text"):
            raw, at = kernels.utf8(batch.column("text"))
            start, end, _ = kernels.words(raw, at, _outside_code)
            long = end - start >= LEAST
            edge = np.zeros(len(raw) + 1, np.int8)
            edge[start[long]] += 1
            edge[end[long]] -= 1
            s = np.where(np.cumsum(edge, dtype=np.int8)[:-1] > 0, N - 1, _symbol[raw])
            s = np.insert(s, at[1:], N - 1)
            total += np.bincount(s[:-1] * N + s[1:], minlength=N * N)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["pair", "n"])

    out = np.zeros(N * N)
    for pair, n in docs.select("text").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[pair] = n
    return out.reshape(N, N)


def text_model(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair counts, counts of first characters, and smoothed shares of single characters, of code characters."""
    own = counts[:-1, :-1]
    return own, own.sum(1), (own.sum(0) + 1) / (own.sum() + len(own))


def encoding(run: str) -> tuple[str, str]:
    used = set(run)
    return next((n, a) for n, a in ENCODINGS.items() if used <= set(a))


def _upper_tail(x: float, k: float) -> float:
    """P(chi-squared with k degrees > x), by the cube-root normal approximation."""
    z = ((max(x, 0) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return min(1.0, max(1e-300, math.erfc(z / math.sqrt(2)) / 2))


def battery(run: str, alphabet: str) -> float:
    """One p-value for "uniform random over this alphabet"; small for text, repeats, counters and the like."""
    n, k = len(run), len(alphabet)
    x = np.array([alphabet.index(c) for c in run])
    counts = np.bincount(x, minlength=k)
    uniform = _upper_tail(float(((counts - n / k) ** 2).sum() * k / n), k - 1)
    high = x >= k / 2
    above = int(high.sum())
    below = n - above
    mean = 2 * above * below / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    changes = math.erfc(abs(runs - mean) / math.sqrt(2 * variance)) if variance > 0 else 1e-9
    d = x - (k - 1) / 2
    serial = math.erfc(abs(float((d[1:] * d[:-1]).sum())) / ((k * k - 1) / 12) / math.sqrt(2 * (n - 1)))
    half = -math.log(uniform) - math.log(max(changes, 1e-300)) - math.log(max(serial, 1e-300))
    return math.exp(-half) * (1 + half + half * half / 2)


def unlike_text(run: str, alphabet: str, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """-log10 of a p-value for "ordinary text": the likelihood ratio of uniform text against the pair model, backed off
    to single characters where a first character is rare."""
    pairs, firsts, single = model
    s = _symbol[np.frombuffer(run.encode(), np.uint8)]
    u, w = s[:-1], s[1:]
    chance = (pairs[u, w] + 8 * single[w]) / (firsts[u] + 8)
    ratio = -(len(run) - 1) * math.log(len(alphabet)) - float(np.log(chance).sum())
    return max(0.0, ratio / math.log(10))


def base_spans(text: str, hexes: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", a, b) for a, b in hexes]


def rest(runs: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What base spans leave of the runs, in parts of LEAST and more characters. Both are taken in order of start."""
    taken, out, k = sorted((a, b) for _, a, b in base), [], 0
    reach = 0
    for a, b in runs:
        a = max(a, reach)
        while k < len(taken) and taken[k][0] < b:
            out.append((a, min(b, taken[k][0])))
            reach = max(reach, taken[k][1])
            a, k = max(a, reach), k + 1
        out.append((a, b))
    return [(a, b) for a, b in out if b - a >= LEAST]


_SPAN = "struct<start:int,kind:int,end:int>"
_FOUND = f"base array<{_SPAN}>, candidates array<struct<start:int,end:int,class:int,bin:int,odd:int,run:long>>"


def _scan(model: tuple[np.ndarray, np.ndarray, np.ndarray], keep: list[str]):
    def judged(run: str) -> tuple[int, int, int, int]:
        """Class of length, bins of -log10 of the text model's and of the battery's p-value, and a hash of the run."""
        alphabet = encoding(run)[1]
        odd = -math.log10(max(1e-300, battery(run, alphabet)))
        bins = (min(BINS - 1, int(x / BIN)) for x in (unlike_text(run, alphabet, model), odd))
        return sum(len(run) >= n for n in LENGTHS) - 1, *bins, xxhash.xxh64_intdigest(run) - (1 << 63)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.chunks(batches, "text"):
            raw, at = kernels.utf8(batch.column("text"))
            start, end, _ = kernels.words(raw, at, _outside_hex)
            long = end - start >= HEX_LEAST
            hexes = np.stack([start[long], end[long]], 1)
            start, end, _ = kernels.words(raw, at, _outside_code)
            long = end - start >= LEAST
            runs = np.stack([start[long], end[long]], 1)
            hex_at, run_at = np.searchsorted(hexes[:, 0], at), np.searchsorted(runs[:, 0], at)
            base_all, cand_all = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = raw[at[i] : at[i + 1]]
                plain = text is None or text.isascii()

                def points(pairs: np.ndarray) -> list[tuple[int, int]]:
                    """Byte offsets in the batch as code point offsets in the text."""
                    pairs = pairs - at[i]
                    if plain or not len(pairs):
                        return [tuple(p) for p in pairs.tolist()]
                    tail = np.concatenate([[0], np.cumsum((own & 0xC0) == 0x80)])
                    return [(int(a - tail[a]), int(b - tail[b])) for a, b in pairs.tolist()]

                text = text or ""
                base = base_spans(text, points(hexes[hex_at[i] : hex_at[i + 1]]))
                base_all.append([{"start": a, "kind": KINDS.index(k), "end": b} for k, a, b in base])
                cands = []
                for a, b in rest(points(runs[run_at[i] : run_at[i + 1]]), base):
                    cands.append(dict(zip(("start", "end", "class", "bin", "odd", "run"), (a, b, *judged(text[a:b])))))
                cand_all.append(cands)
            span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
            cand = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("bin", pa.int32()), ("odd", pa.int32()), ("run", pa.int64())])
            arrays = [batch.column(k) for k in keep] + [pa.array(base_all, pa.list_(span)), pa.array(cand_all, pa.list_(cand))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "base", "candidates"])

    return scan


def thresholds(counts: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """Benjamini-Hochberg on binned p-values, per class of length, from (class, bin of -log10 p, runs): the first bin that
    is a discovery."""
    out = {}
    for level in range(len(LENGTHS)):
        own = Counter()
        for c, b, n in counts:
            own[b] += n if c == level else 0
        total, seen, out[level] = sum(own.values()), 0, BINS
        for b in sorted(own, reverse=True):
            seen += own[b]
            if total * 10 ** (-b * BIN) <= rate * seen:
                out[level] = b
    return out


def scan(docs: DataFrame, keep: list[str], rate: float = 0.01, fair: float = 0.001) -> DataFrame:
    """keep columns, and spans: array of (start, kind, end), sorted, in code points, end exclusive, kind as in KINDS.

    docs needs text and the columns of keep. Null text is empty. Base spans are the patterns' leftmost non-overlapping
    matches; random ones are added where they overlap none. Repeated rows each keep a row with the same spans; a run
    that repeats counts once for the thresholds. rate: share of random spans that may be ordinary text; fair: share of
    the runs that the battery dismisses that may be random. An empty table gives an empty result. A text of any length
    is scanned whole.
    """
    short_batches(docs.sparkSession)
    model = text_model(pair_counts(docs))
    columns = [f"`{k}` {dict(docs.dtypes)[k]}" for k in keep]
    cols = list(dict.fromkeys([*keep, "text"]))
    found = docs.select(*cols).mapInArrow(_scan(model, keep), ", ".join([*columns, _FOUND]))
    found = written(found, "secret-spans")
    runs = found.select(F.explode("candidates").alias("c")).select("c.run", "c.class", "c.bin", "c.odd").distinct()
    bins = [tuple(r) for r in runs.groupBy("class", "bin", "odd").count().collect()]
    random, dismissed = thresholds([(c, b, n) for c, b, _, n in bins], rate), thresholds([(c, o, n) for c, _, o, n in bins], fair)
    at = lambda found, c: F.get(F.array(*[F.lit(found[k]) for k in range(len(LENGTHS))]), c["class"])
    added = F.transform(
        F.filter("candidates", lambda c: (c["bin"] >= at(random, c)) & (c["odd"] < at(dismissed, c))),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")),
    )
    return found.select(*keep, F.array_sort(F.concat("base", added)).alias("spans"))


def _said(spans: F.Column) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: F.Column, spans: F.Column, mark: str = "[SECRET]") -> F.Column:
    """text with every span, merged where they overlap, replaced by the mark."""
    start = "struct<at:int,out:string>"
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(start),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(x["end"].alias("at"), F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("out")),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(walk["out"], F.substr(text, walk["at"] + 1, F.length(text))))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"),
    )


QUERIES = {"op7_secret_scans": op7_secret_scans}
ORACLE: dict[str, str] = {}
