"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel counts common subsequences of three letters, each weighed by 0.5 per letter it spans, so that an insult with
inserted or missing characters stays close to its plain form. Landmarks are strings: word beginnings that stand mostly
in texts labelled toxic, chosen greedily so that together they reach as many of them as they can, and frequent words of
the other texts. A word's kernel values against the landmarks are evaluated where it has all letters of a landmark but
one in their order (a bit-parallel longest-common-subsequence test), else 0. A text's vector holds the maximum over its
words and their sum in relation to its length, for each landmark, and the maximum and sum over all landmarks taken from
toxic texts; the Nystroem map whitens the former by the landmarks' own kernel matrix; the
machine is trained on such vectors of labelled texts, and a logistic curve turns its margin into a score from 0 to 1.

Only fitting is bounded (`most` labelled texts of either class, by a hash of their id). Every text is scored whole, in
the scan: no shuffle. Each distinct word is evaluated once for a batch and kept, within a bound, for later ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import documents, short_batches

DECAY, ORDER, FAINT, PER, START, STEPS = 0.5, 3, 0.45, 30, "^", 1 << 20


_DROP = bytes(b for b in range(128) if not chr(b).isalpha())


def plain(chunk: bytes) -> str:
    """The letters of a word, in lower case: what stands between them doesn't count."""
    word = chunk.translate(None, _DROP).decode("utf-8", "replace").lower()
    return word if word.isalpha() or not word else "".join(c for c in word if c.isalpha())


def codes(words: list[str], width: int) -> np.ndarray:
    """Code points, (words, width), -1 beyond a word's end."""
    joined = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), width), -1, np.int32)
    out[np.arange(width) < size[:, None]] = joined
    return out


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The subsequence kernel of row i of s with row i of t (code points, -1 and -2 as filling). All sums go row by row
    in one order, so that a row's value doesn't depend on the rows and the filling beside it."""
    n, p, q = len(s), s.shape[1], t.shape[1]
    before = np.ones((q + 1, p + 1, n), np.float32)
    same = (s.T[None] == t.T[:, None]).astype(np.float32)
    total = np.zeros(n, np.float32)
    for _ in range(ORDER - 1):
        after = np.zeros_like(before)
        for j in range(1, p + 1):
            run = np.zeros(n, np.float32)
            for i in range(1, q + 1):
                run = DECAY * run + DECAY * DECAY * same[i - 1, j - 1] * before[i - 1, j - 1]
                after[i, j] = DECAY * after[i, j - 1] + run
        before = after
    for row in (same * before[:-1, :-1]).reshape(q * p, n):
        total += row
    return DECAY * DECAY * total


def reachable(s: np.ndarray, landmarks: list[str]) -> np.ndarray:
    """(words, landmarks): has the word all letters of the landmark but one, in order?"""
    letters = sorted({ord(c) for x in landmarks for c in x})
    masks = np.zeros((len(letters) + 1, len(landmarks)), np.uint16)
    for k, x in enumerate(landmarks):
        for i, c in enumerate(x):
            masks[letters.index(ord(c)), k] |= 1 << i
    letters = np.array(letters)
    at = np.searchsorted(letters, s)
    at[at == len(letters)] = 0
    at = np.where(letters[at] == s, at, len(letters))
    full = np.array([(1 << len(x)) - 1 for x in landmarks], np.uint16)
    state = np.broadcast_to(full, (len(s), len(landmarks))).copy()
    for i in range(s.shape[1]):
        m = masks[at[:, i]]
        u = state & m
        state = (state + u) | (state & ~m)
    missing = np.bitwise_count(state & full)
    return missing <= 1


@dataclass
class Model:
    landmarks: list[str]
    bad: int  # so many landmarks, the first, are from toxic texts
    own: np.ndarray  # each landmark's kernel with itself
    weights: np.ndarray  # of kernel values, the Nystroem map included
    bias: float
    slope: float
    shift: float

    def word_vectors(self, words: list[str]) -> np.ndarray:
        """Kernel values (words, landmarks), 0 if under FAINT, at most 1, in steps of 2**-20: sums of so many of them as a
        text has words are exact in double precision, whatever their order."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not self.landmarks or not words:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = max(map(len, self.landmarks))
        t = codes(self.landmarks, width)
        t[t == -1] = -2
        order = np.argsort(size, kind="stable")
        cuts = [0, *np.searchsorted(size[order], [7, 10, 14, 20, 40, 100, 1000]).tolist(), len(words)]
        for a, b in zip(cuts, cuts[1:]):
            for low in range(a, b, 20_000):
                rows = order[low : min(b, low + 20_000)]
                s = codes([START + words[i] for i in rows], max(3, int(size[rows].max()) + 1))
                w, k = np.nonzero(reachable(s, self.landmarks))
                step = max(64, 2_000_000 // (s.shape[1] * width))
                for x in range(0, len(w), step):
                    ws, ks = w[x : x + step], k[x : x + step]
                    out[rows[ws], ks] = kernel(s[ws], t[ks]) / self.own[ks]
        out[out < FAINT] = 0
        return np.round(np.minimum(out, 1, out=out) * STEPS) / np.float32(STEPS)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = (x * self.weights).sum(1) + self.bias  # a matrix product may round a row by the rows beside it
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def pool(vectors: np.ndarray, times: np.ndarray, total: int, bad: int) -> np.ndarray:
    """A text's vector: for each landmark the largest value, and the sum over words in relation to the text's length;
    then the largest of the first `bad` landmarks' values, and their sum."""
    vectors = vectors.astype(np.float64)
    most = vectors.max(0)
    own = most[:bad]
    return np.concatenate([most, np.minimum(PER * (times @ vectors) / (total + PER), 3), [own.max(initial=0), min(own.sum(), 3)]])


def choose_landmarks(known: list[str], bags: list[np.ndarray], toxic: np.ndarray, wanted: int, others: int) -> tuple[list[str], int]:
    """Beginnings of words (4 to 8 letters) that stand mostly in toxic texts, either at all or in two different words
    of a text; greedily those that reach the most toxic texts not yet reached, less a penalty for other texts. Each is
    drawn out as long as nearly all its texts stay. Then the most widespread words of the other texts. A mark stands
    for the word's start. known: all words; bags: each text's distinct words, as numbers of known. With it comes how many are from toxic texts."""
    sizes = range(4, 9)
    spelt = lambda x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 & ~1
    codes_of = np.array([[spelt(w[:n]) if len(w) >= n else 0 for n in sizes] for w in known], np.int64).reshape(-1, len(sizes))

    def grams(bag: np.ndarray) -> np.ndarray:
        """Distinct beginnings of a text's words; an odd number for those of two words and more."""
        own, n = np.unique(codes_of[bag].ravel(), return_counts=True)
        return np.concatenate([own[own != 0], own[(own != 0) & (n > 1)] | 1])

    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    least, scale = 2 if n_bad < 60 else 3 if n_bad < 300 else 5, n_bad / n_good
    of = {int(i): grams(bags[i]) for i in np.flatnonzero(toxic)}
    keys, bad = np.unique(np.concatenate(list(of.values())), return_counts=True)
    keys, bad = keys[bad >= least], bad[bad >= least]
    good = np.zeros(len(keys), np.int64)
    for i in np.flatnonzero(~toxic):
        g = grams(bags[i])
        at = np.searchsorted(keys, g)
        at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == g)] if len(keys) else at[:0]
        good[at] += 1
    fit = bad >= 6 * (good + 0.1) * scale
    count = {int(k): (int(n), int(m)) for k, n, m in zip(keys[fit], bad[fit], good[fit])}
    word, size = np.nonzero(np.isin(codes_of, [k & ~1 for k in count]))
    name = {int(codes_of[w, n]): known[w][: sizes[n]] for w, n in zip(word, size)}
    name |= {k: name[k & ~1] for k in count}
    own = {i: [int(k) for k in g[np.isin(g, list(count))]] for i, g in of.items()}
    within: dict[int, set[int]] = {k: set() for k in count}
    for i, g in own.items():
        for k in g:
            within[k].add(i)
    gain = {k: len(x) for k, x in within.items()}
    left, chosen = set(own), []

    def drawn_out(k: int) -> str:
        return max((name[j] for j in count if j & 1 == k & 1 and name[j].startswith(name[k]) and count[j][0] >= 0.85 * count[k][0]), key=len)

    def worth(k: int) -> float:
        return gain[k] - 2 * count[k][1] * min(1, scale * 4)

    while gain and len(chosen) < wanted:
        best = max(gain, key=lambda k: (worth(k), -(k & 1), len(name[k]), name[k]))
        if worth(best) < least:
            break
        for i in within[best] & left:
            left.discard(i)
            for k in own[i]:
                gain[k] -= 1
        chosen.append(drawn_out(best))
    # every widespread insult is a landmark, also where others already reach its texts
    wide = [k for k, (n, m) in count.items() if n >= max(least, 0.03 * n_bad) and n >= 40 * m * scale]
    for k in sorted(wide, key=lambda k: (-count[k][0], -len(name[k]), name[k], k & 1)):
        if len(chosen) < wanted and not any(name[k].startswith(c[:4]) for c in chosen):
            chosen.append(drawn_out(k))
    texts = np.bincount(np.concatenate([b for b, y in zip(bags, toxic) if not y] or [np.zeros(0, np.int64)]), minlength=len(known))
    common = sorted((w for w in np.argsort(-texts, kind="stable")[:5000] if 4 <= len(known[w]) <= 8), key=lambda w: (-texts[w], known[w]))
    marks = [START + g for g in dict.fromkeys(chosen)]
    return marks + [START + known[w] for w in common[:others] if known[w] not in chosen], len(marks)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, float]:
    """A linear machine with hinge loss by dual coordinate descent; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y, 1.0, -1.0)
    most = cost * np.where(y, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (~y).sum())))
    alpha, w, norm = np.zeros(len(x)), np.zeros(x.shape[1]), (x * x).sum(1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (sign[i] * (x[i] @ w) - 1) / norm[i], 0.0), most[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from margin to probability (Newton steps with a small ridge)."""
    a, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        a = a - np.linalg.solve(h, x.T @ (p - y) + 1e-3 * (a - [1, 0]))
    return float(a[0]), float(a[1])


def labelled(docs: DataFrame, labels: DataFrame, most: int, longest: int) -> DataFrame:
    """(doc_id, toxic, words, times, total) of at most `most` labelled texts of either class of at most
    `longest` characters, outside the held-out fold; the ids of the sample, bounded so, are what is broadcast. A doc_id
    labelled both ways is left out; of texts that share a doc_id the least stands for all."""
    own = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 4 != 2")
    own = own.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic")
    some = [own.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(some[0].unionAll(some[1])), "doc_id")
    rows = rows.where(F.length(F.coalesce("text", F.lit(""))) <= longest).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [_words(text) for text in batch.column("text").to_pylist()]
            words = pa.array([" ".join(c) for c in counts], pa.string())
            times = pa.array([np.array(list(c.values()), "<u4").tobytes() for c in counts], pa.binary())
            total = pa.array([len(_chunks(text)) for text in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), words, times, total], ["doc_id", "toxic", "words", "times", "total"])

    return rows.mapInArrow(bags, "doc_id long, toxic int, words string, times binary, total long")


def _chunks(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _spelt(single: np.ndarray, chunks: list[bytes]) -> list[str]:
    """Words spelt with blanks between their letters: runs of three and more single letters."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]])))
    return ["".join(map(plain, chunks[a:b])) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= 3]


def _words(text: str | None) -> Counter[str]:
    found, out = _chunks(text), Counter()
    for c, n in Counter(found).items():
        if len(w := plain(c)) >= 3:
            out[w] += n
    out.update(_spelt(np.fromiter((len(plain(c)) == 1 for c in found), bool, len(found)), found))
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = 1500, wanted: int = 48, others: int = 2, longest: int = 1 << 16) -> Model:
    """Fits on a bounded sample: at most `most` labelled texts of either class, of at most `longest` characters each.
    Without texts of both classes the model gives every text the same score: the share of toxic ones (or 0)."""
    short_batches(docs.sparkSession)
    rows = [r[1:] for r in sorted(labelled(docs, labels, most, longest).collect(), key=lambda r: r[0])]
    y = np.array([r[0] == 1 for r in rows], bool)
    if not y.any() or y.all():
        share = float(y.mean()) if len(y) else 0.0
        return Model([], 0, np.zeros(0), np.zeros(0), 0.0, 0.0, 30.0 if share == 1 else -30.0)
    number: dict[str, int] = {}
    bags = [np.fromiter((number.setdefault(w, len(number)) for w in r[1].split()), np.int64) for r in rows]
    counts, totals = [np.frombuffer(r[2], "<u4").astype(np.float64) for r in rows], [r[3] for r in rows]
    del rows
    known = list(number)
    marks, bad = choose_landmarks(known, bags, y, wanted, others)
    if not marks:
        return Model([], 0, np.zeros(0), np.zeros(0), 0.0, 0.0, -30.0)
    width = max(map(len, marks))
    t = codes(marks, width)
    pairs = np.stack(np.meshgrid(np.arange(len(marks)), np.arange(len(marks)), indexing="ij"), -1).reshape(-1, 2)
    gram = kernel(t[pairs[:, 0]], np.where(t == -1, -2, t)[pairs[:, 1]]).reshape(len(marks), -1).astype(float)
    own = np.diag(gram).astype(np.float32)
    model = Model(marks, bad, own, np.zeros(2 * len(marks) + 2), 0.0, 1.0, 0.0)
    vectors = model.word_vectors(known)
    x = np.zeros((len(bags), 2 * len(marks) + 2))
    for i, bag in enumerate(bags):
        if len(bag):
            x[i] = pool(vectors[bag], counts[i], totals[i], bad)
    value, basis = np.linalg.eigh(gram / np.sqrt(np.outer(own, own)))
    half = basis @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ basis.T
    nystroem = np.eye(2 * len(marks) + 2)
    for a in (0, len(marks)):
        nystroem[a : a + len(marks), a : a + len(marks)] = half
    w, bias = train_svm(x @ nystroem, y)
    model.weights, model.bias = nystroem @ w, bias
    model.slope, model.shift = logistic(x @ model.weights + bias, y.astype(float))
    return model


class _Scorer:
    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most = model, most
        self.at: dict[bytes, int] = {}  # 0: reaches no landmark; -1: a single letter; else a row of vectors
        self.vectors = np.zeros((1, len(model.landmarks)), np.float32)

    def learn(self, new: list[bytes]) -> None:
        if len(self.at) + len(new) > self.most:
            self.at, self.vectors = {}, self.vectors[:1]
        words = list(map(plain, new))
        forms = sorted({w for w in words if len(w) >= 3})
        vectors = self.model.word_vectors(forms)
        hit = vectors.any(1)
        number = np.where(hit, np.cumsum(hit) + len(self.vectors) - 1, 0)
        self.vectors = np.concatenate([self.vectors, vectors[hit]])
        place = dict(zip(forms, number.tolist()))
        self.at.update((c, place.get(w, -1 if len(w) == 1 else 0)) for c, w in zip(new, words))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        split = [_chunks(t) for t in texts]
        seen = set().union(*split)
        new = list(seen - self.at.keys())
        if len(self.at) + len(new) > self.most:
            new = list(seen)
        if new:
            self.learn(new)
        x = np.zeros((len(texts), len(self.model.weights)))
        for i, parts in enumerate(split):
            at = np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))
            rows, times = np.unique(at[at > 0], return_counts=True)
            vectors = self.vectors[rows]
            if np.count_nonzero(single := at == -1) >= 3 and (spelt := _spelt(single, parts)):
                vectors, times = np.concatenate([vectors, self.model.word_vectors(spelt)]), np.append(times, np.ones(len(spelt), np.int64))
            if len(vectors):
                x[i] = pool(vectors, times.astype(np.float64), len(parts), self.model.bad)
        return self.model.score(x)


def _scorer(model: Model) -> _Scorer:
    """The scorer of this worker process, which later tasks with the same model use again."""
    key = repr((model.landmarks, model.weights.tobytes(), model.bias, model.slope, model.shift))
    return kernels.keep_one(key, lambda: _Scorer(model))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int) added, which replace columns of these names.

    docs needs text. Null and empty texts have the score of a text without any insult. Equal texts score alike,
    whatever stands beside them: kernel values are kept in steps whose sums are exact.
    """
    short_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in kernels.chunks(batches, "text", table=True):
            got = scorer.scores(batch.column("text").to_pylist())
            arrays = [*batch.columns, pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "score", "predicted"])

    return docs.select(*columns).mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is in no fold: its held_out is null; its text is scored as any other."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}
