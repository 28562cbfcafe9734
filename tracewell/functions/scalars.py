"""Scalar columns: classification, playbook, fingerprints, carve classes, byte statistics, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The class of each needle as (needles, type, confidence, encrypted).
CLASSES = [
    (["crypted_key"], "bitcoin-core-legacy", "high", True),
    (["hdseed", "keymeta"], "bitcoin-core-legacy", "high", False),
    (["orderposnext", "addrIncoming", "bestblock", "defaultkey", "acentry"], "bitcoin-core-legacy", "medium", False),
    (["walletdescriptor"], "bitcoin-core-descriptor", "high", False),
    (["activeblock"], "bitcoin-core-descriptor", "medium", False),
    (["wallet.dat"], "wallet-filename", "low", False),
    (["wif", "wif-testnet"], "private-key-wif", "high", False),
    (["xprv", "tprv", "yprv", "zprv", "uprv", "vprv"], "extended-private-key", "high", False),
    (["xpub", "tpub", "ypub", "zpub", "upub", "vpub"], "extended-public-key", "high", False),
    (["eth-keystore"], "ethereum-keystore", "high", True),
    (["electrum-seed"], "electrum-seed", "high", False),
    (["electrum-file"], "electrum-file", "high", False),
    (["descriptor"], "descriptor", "high", False),
    (["slip39-20", "slip39-33"], "slip39-share", "high", False),
    (["open-chan-bucket", "closed-chan-bucket"], "lightning-lnd", "medium", False),
    (["channel.backup", "channel.db"], "lightning-lnd", "low", False),
    (["metamask-vault"], "metamask-vault", "high", True),
    (["pem-private-key"], "pem-private-key", "high", False),
    (["aws-access-key"], "aws-access-key", "high", False),
    (["github-token"], "github-token", "high", False),
]
# The order of types in the playbook.
PLAYBOOK = [
    "bitcoin-core-legacy", "bitcoin-core-descriptor", "bip39-seed", "private-key-wif", "extended-private-key",
    "extended-public-key", "ethereum-keystore", "electrum-seed", "electrum-file", "descriptor", "slip39-share",
    "lightning-lnd", "metamask-vault", "pem-private-key", "aws-access-key", "github-token", "wallet-filename", "unknown",
]
# File-format magics in order of precedence, as (class, bytes in hex).
MAGICS = [
    ("sqlite", "53514c69746520666f726d6174203300"), ("bdb", "62310500"), ("bdb", "61150600"),
    ("bbolt", "ed0cdaed"), ("gzip", "1f8b"), ("zip", "504b0304"),
]


def classify(needle: Column, verified: Column | None = None) -> Column:
    """struct(type, confidence, encrypted) of a needle; a private-key block that isn't verified is of medium confidence."""

    def of(kind: str, confidence: str, encrypted: bool) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(encrypted).alias("encrypted"))

    seed = needle.startswith("bip39-")
    out = F.when(seed & needle.contains("near-miss"), of("bip39-seed", "medium", False))
    out = out.when(seed & needle.contains("unordered"), of("bip39-seed", "low", False)).when(seed, of("bip39-seed", "high", False))
    for names, kind, confidence, encrypted in CLASSES:
        level = of(kind, confidence, encrypted)
        if verified is not None and "pem-private-key" in names:
            out = out.when(needle.isin(names) & ~F.coalesce(verified, F.lit(False)), of(kind, "medium", encrypted))
        out = out.when(needle.isin(names), level)
    return out.otherwise(of("unknown", "low", False))


def latin(data: Column) -> Column:
    """Bytes as a string of one character each: positions in it are byte offsets."""
    return F.decode(data, "ISO-8859-1")


def sums_before(numbers: Column, step: int = 256) -> Column:
    """The sum of all numbers (bigint) before each one. Longer arrays go by chunks, so that the arrays that an aggregation
    appends to stay short: its work is in proportion to n * step + (n / step)**2."""
    whole = F.size(numbers)
    begins = F.when(whole > 0, F.sequence(F.lit(1), F.greatest(whole, F.lit(1)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(begins, lambda a: F.slice(numbers, a, step))

    def running(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(values, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["sums"], F.array(s["at"])).alias("sums")))["sums"]

    totals = running(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, n: a + n)))
    return F.when(whole <= step, running(numbers)).otherwise(F.flatten(F.zip_with(parts, totals, lambda p, t: F.transform(running(p), lambda x: x + t))))


def occurrences(text: Column, literal: str) -> Column:
    """Offsets (from 0) of the non-overlapping occurrences of a literal: running lengths of the parts between them."""
    parts = F.split(text, "\\Q" + literal + "\\E")
    sizes = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p).cast("bigint"))
    return F.zip_with(sums_before(F.transform(sizes, lambda n: n + len(literal))), sizes, lambda at, n: at + n)


def fingerprint(relative: Column, needle: Column, line: Column) -> Column:
    """v1/<path>/<needle>/<first 8 bytes of the line's SHA-256 in hex>; line is binary."""
    return F.concat_ws("/", F.lit("v1"), relative, needle, F.left(F.sha2(line, 256), F.lit(16)))


def history_fingerprint(commit: Column, path: Column, needle: Column, line: Column) -> Column:
    return F.concat_ws("/", F.lit("v1"), F.lit("history"), commit, path, needle, F.left(F.sha2(line, 256), F.lit(16)))


def match_line(text: Column, offset: Column, length: Column, back: int = 4096, forward: int = 8192) -> Column:
    """The line around a match in a one-character-a-byte text: it starts after the nearest line feed at or before the
    offset, at most `back` bytes before it, and ends before the first one at or after the match's end, `forward` after."""
    start = F.greatest(offset - back, F.lit(0))
    before = F.substr(text, (start + 1).cast("int"), (offset - start + 1).cast("int"))
    rest = F.substr(text, (offset + length + 1).cast("int"), F.lit(forward))
    tail = F.substring_index(before, "\n", -1)
    own = F.substr(text, (offset + 2).cast("int"), (length - 1).cast("int"))
    return F.concat(tail, own, F.substring_index(rest, "\n", 1))


def token_words(text: Column) -> Column:
    """Maximal runs of 3 to 32 ASCII letters and digits; longer runs are no token."""
    return F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.length(w).between(3, 32))


def token_variants(word: Column) -> Column:
    """The word, in lower case, in upper case and capitalised, without repeats."""
    return F.array_distinct(F.array(word, F.lower(word), F.upper(word), F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))))


def valid_base64(text: Column, at_least: int, at_most: int | None = None) -> Column:
    size = F.octet_length(F.try_to_binary(text, F.lit("base64")))
    fits = size >= at_least if at_most is None else size.between(at_least, at_most)
    return F.coalesce(fits & text.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(text) % 4 == 0), F.lit(False))
