"""Word evidence: tokens, runs and fixed-length windows of listed words, with their checksums.

A word list is a DataFrame (word, ix) that the caller supplies; it is small and bounded by its standard (2,048 or 1,024
rows), so it is broadcast. Tokens are cut in the scan by one Arrow kernel, as their byte offsets are running sums that
row-wise expressions can't give in linear time; all that follows is windows over (target, run) and built-ins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED_LENGTHS, SHARE_LENGTHS, MAX_SPAN = (12, 15, 18, 21, 24), (20, 33), 511
# The generators of the share checksum, and the version prefixes of the other seed family.
SHARE_GENERATORS = [0xE0E040, 0x1C1C080, 0x3838100, 0x7070200, 0xE0E0009, 0x1C0C2412, 0x38086C24, 0x3090FC48, 0x21B1F890, 0x3F3F120]
VERSION_PREFIXES = ["01", "100", "101", "102"]
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def letter_runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ASCII letters."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _LETTER[np.frombuffer(data, np.uint8)], [False]])))
    return edge[0::2], edge[1::2]


def tokens(sources: DataFrame, most: int = 1 << 18) -> DataFrame:
    """(target, pos, start, end, word) of every maximal run of ASCII letters in data (binary), in lower case."""

    def made(parts: list[tuple]) -> pa.RecordBatch:
        target = pa.concat_arrays([pa.repeat(pa.scalar(t, pa.string()), len(a)) for t, _, a, _, _ in parts])
        pos, start, end = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        low = [p[4] for p in parts]
        word = [x[a:b] for x, p in zip(low, parts) for a, b in zip(p[2].tolist(), p[3].tolist())]
        return pa.RecordBatch.from_arrays([target, pa.array(pos), pa.array(start), pa.array(end), pa.array(word, pa.binary()).cast(pa.string())], ["target", "pos", "start", "end", "word"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for target, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start, end = letter_runs(data or b"")
                low = (data or b"").lower()
                for k in range(0, len(start), most):
                    own = start[k : k + most], end[k : k + most]
                    parts.append((target, np.arange(k, k + len(own[0]), dtype=np.int64), *own, low))
                    held += len(own[0])
                    if held >= most:
                        yield made(parts)
                        parts, held = [], 0
        if parts:
            yield made(parts)

    return sources.select("target", "data").mapInArrow(cut, "target string, pos bigint, start bigint, end bigint, word string")


def listed(toks: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens in the list, with ix. The length gate comes before the join."""
    return toks.where(F.length("word").between(3, 8)).join(F.broadcast(words), "word").select("target", "pos", "start", "end", "word", "ix")


def runs(valid: DataFrame) -> DataFrame:
    """Adds run: consecutive tokens of one target share it (gaps and islands)."""
    return valid.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("target").orderBy("pos")))


def run_spans(valid: DataFrame, least: int = 12) -> DataFrame:
    return runs(valid).groupBy("target", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("words")).where(F.col("words") >= least)


def windows(valid: DataFrame, n: int) -> DataFrame:
    """(target, start, end, ixs, phrase) of every n consecutive listed tokens."""
    w = Window.partitionBy("target", "run").orderBy("pos").rowsBetween(0, n - 1)
    out = runs(valid).select(
        "target", "start", F.max("end").over(w).alias("end"), F.collect_list("ix").over(w).alias("ixs"), F.collect_list("word").over(w).alias("phrase")
    )
    return out.where(F.size("ixs") == n)


def seed_checksum_ok(ixs: Column, n: int) -> Column:
    """SHA-256 checksum of packed 11-bit indices, by built-ins only."""
    check = n // 3
    entropy = n * 11 - check
    bits = F.array_join(F.transform(ixs, lambda i: F.lpad(F.conv(i.cast("string"), 10, 2), 11, "0")), "")
    octets = F.transform(F.sequence(F.lit(0), F.lit(entropy // 8 - 1)), lambda k: F.lpad(F.conv(F.substr(bits, k * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    digest = F.lpad(F.conv(F.left(F.sha2(F.unhex(F.array_join(octets, "")), 256), F.lit(2)), 16, 2), 8, "0")
    return F.left(digest, F.lit(check)) == F.substr(bits, F.lit(entropy + 1))


def seeds(valid: DataFrame, n: int) -> DataFrame:
    """Exact seeds of n words: label, target, start, end."""
    found = windows(valid, n).where(F.col("end") - F.col("start") <= MAX_SPAN).where(seed_checksum_ok(F.col("ixs"), n))
    return found.select("target", F.lit(f"bip39-{n}").alias("needle"), "start", "end", "phrase")


def versioned_seeds(valid: DataFrame) -> DataFrame:
    """12-word seeds whose HMAC-SHA512 under the version key has a known prefix: the HMAC from its definition."""
    key = b"Seed version".ljust(128, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    text = F.encode(F.array_join("phrase", " "), "UTF-8")
    mac = F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), text), 512))), 512)
    found = windows(valid, 12).withColumn("mac", mac)
    starts = [F.col("mac").startswith(p) for p in VERSION_PREFIXES]
    return found.where(starts[0] | starts[1] | starts[2] | starts[3]).select("target", F.lit("electrum-seed").alias("needle"), "start", "end", "phrase")


def share_checksum_ok(ixs: Column) -> Column:
    """The 30-bit checksum over the customization string, which the extendable bit selects, and the words."""

    def polymod(prefix: bytes) -> Column:
        def step(c: Column, v: Column) -> Column:
            top = F.shiftright(c, 20)
            out = F.shiftleft(c.bitwiseAND(F.lit(0xFFFFF)), 10).bitwiseXOR(v)
            for i, g in enumerate(SHARE_GENERATORS):
                out = out.bitwiseXOR(F.when(F.shiftright(top, i).bitwiseAND(F.lit(1)) == 1, F.lit(g)).otherwise(F.lit(0)))
            return out.cast("bigint")

        values = F.concat(F.array(*[F.lit(b).cast("bigint") for b in prefix]), F.transform(ixs, lambda x: x.cast("bigint")))
        return F.aggregate(values, F.lit(1).cast("bigint"), step)

    second, third, fourth = (F.try_element_at(ixs, F.lit(k)) for k in (2, 3, 4))
    extendable = F.shiftright(second, 4).bitwiseAND(F.lit(1)) == 1
    threshold = F.shiftright(third, 2).bitwiseAND(F.lit(15))
    groups = F.shiftleft(third.bitwiseAND(F.lit(3)), 2).bitwiseOR(F.shiftright(fourth, 8))
    return (threshold <= groups) & (F.when(extendable, polymod(b"shamir_extendable")).otherwise(polymod(b"shamir")) == 1)


def shares(valid: DataFrame, n: int) -> DataFrame:
    found = windows(valid, n).where(share_checksum_ok(F.col("ixs")))
    return found.select("target", F.lit(f"slip39-{n}").alias("needle"), "start", "end", "phrase")


def unordered_runs(valid: DataFrame, stronger: DataFrame) -> DataFrame:
    """Maximal runs of 12 and more listed words that hold no stronger evidence: an interval anti-join within a target."""
    spans = run_spans(valid).select("target", F.lit("bip39-unordered").alias("needle"), "start", "end")
    return without_contained(spans, stronger, outer=True)


def without_contained(weak: DataFrame, strong: DataFrame, outer: bool = False, strictly: bool = False) -> DataFrame:
    """Drops weak spans that lie inside a strong one of their target (outer: that have a strong one inside)."""
    s = strong.select(F.col("target").alias("t"), F.col("start").alias("a"), F.col("end").alias("b"))
    inside = (F.col("a") >= F.col("start")) & (F.col("b") <= F.col("end")) if outer else (F.col("start") >= F.col("a")) & (F.col("end") <= F.col("b"))
    if strictly:
        inside = inside & ((F.col("b") - F.col("a")) != (F.col("end") - F.col("start")))
    return weak.join(s, (F.col("target") == F.col("t")) & inside, "left_anti")


def deletions(word: str, edits: int = 2) -> list[str]:
    """The word and what is left of it when up to `edits` of its letters go: two words within so many edits share one."""
    out = {word}
    for _ in range(edits):
        out |= {w[:k] + w[k + 1 :] for w in out for k in range(len(w))}
    return sorted(out)


def typos(toks: DataFrame, words: DataFrame) -> DataFrame:
    """(word, candidates, least_edits, first_candidate): listed words within two edits of each distinct token of 3 to 10
    letters that isn't listed. Tokens and words meet where they share what is left after up to two deletions, which words
    within two edits always do, so that no token is held against the whole list. The list, of a standard's size (2,048
    words of up to 8 letters, checked), is broadcast with its rests: under 76,000 rows."""
    if (n := words.count()) > 2048:
        raise ValueError(f"a word list of {n} words: at most 2,048 are read")

    @F.arrow_udf("array<string>")
    def left(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in batches:
            yield pa.array([deletions(w) for w in own.to_pylist()], pa.list_(pa.string()))

    own = toks.where(F.length("word").between(3, 10)).select("word").distinct().join(F.broadcast(words.select("word")), "word", "left_anti")
    known = words.select(F.col("word").alias("candidate")).withColumn("key", F.explode(left("candidate")))
    pairs = own.withColumn("key", F.explode(left("word"))).join(F.broadcast(known), "key").select("word", "candidate").distinct()
    near = pairs.withColumn("edits", F.levenshtein("word", "candidate", 2)).where("edits >= 0")
    return near.groupBy("word").agg(F.count("*").alias("candidates"), F.min("edits").alias("least_edits"), F.min("candidate").alias("first_candidate"))
