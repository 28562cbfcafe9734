"""Structured evidence found by shape: JSON wallets, vaults, key records, credentials, descriptors.

A shape is a pattern on the one-character-a-byte view and a check of what it captures. Matches are located by a running
``locate`` over the pattern's matches, so that all stays in the JVM; offsets are bytes.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELECTRUM_FILE = r'(?s)"seed_version"\s*:\s*[0-9]+.{0,2000}?"wallet_type"\s*:\s*"[^"\\]*"|"wallet_type"\s*:\s*"[^"\\]*".{0,2000}?"seed_version"\s*:\s*[0-9]+'
ACCESS_KEY, TOKEN = r"\bAKIA[A-Z0-9]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{36}\b"
PEM = r"-----BEGIN ((?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY)-----\s+([A-Za-z0-9+/=\s]+?)-----END \1-----"
REACH, _SPACE = 2048, rb"[ \t\r\n]*"
RECORD = r"(?s)(?=(0.{48}\x08.{8}\x00{4}.{4}))"


def matches(raw: Column, pattern: str, group: int = 0) -> Column:
    """array<struct(offset, text)> of a pattern's matches, in order."""
    state = "struct<at:int,out:array<struct<offset:bigint,text:string>>>"
    walk = F.aggregate(
        F.regexp_extract_all(raw, F.lit(pattern), F.lit(group)),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<offset:bigint,text:string>>").alias("out")).cast(state),
        lambda s, m: F.struct(
            (F.call_function("locate", m, raw, s["at"]) + (F.length(m) if group == 0 else F.lit(1))).alias("at"),
            F.concat(s["out"], F.array(F.struct((F.call_function("locate", m, raw, s["at"]) - 1).cast("bigint").alias("offset"), m.alias("text")))).alias("out"),
        ),
    )
    return walk["out"]


def found(sources: DataFrame, needle: str, pattern: str, anchor: str, group: int = 0) -> DataFrame:
    """(target, needle, offset, match_length, text): the cheap anchor test comes first."""
    rows = sources.where(F.col("raw").contains(anchor)).select("target", F.explode(matches(F.col("raw"), pattern, group)).alias("m"))
    return rows.select("target", F.lit(needle).alias("needle"), F.col("m.offset").alias("offset"), F.length("m.text").alias("match_length"), F.col("m.text").alias("text"))


def electrum_files(sources: DataFrame) -> DataFrame:
    return found(sources, "electrum-file", ELECTRUM_FILE, '"seed_version"')


def decoded(text: bytes) -> bytes | None:
    try:
        return base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        return None


def vault_spans(data: bytes) -> list[tuple[int, int]]:
    """[start, end) of vaults in plain and escaped JSON: an "iv" of 16 bytes, and within REACH of it the first "data", of 16
    bytes and more, and the first "salt", of 32, in any order, among any other keys, with any white space."""
    out = []
    for quote in (b'"', b'\\"'):
        value = re.compile(_SPACE + b":" + _SPACE + re.escape(quote) + b'([^"]{0,%d})' % (REACH + len(quote) - 1) + re.escape(quote))
        at = data.find(quote + b"iv" + quote)
        while at >= 0:
            low, high, found = max(0, at - REACH), min(len(data), at + REACH), []
            for key, fits in ((b"iv", lambda n: n == 16), (b"data", lambda n: n >= 16), (b"salt", lambda n: n == 32)):
                name = quote + key + quote
                place = at if key == b"iv" else data.find(name, low, high)
                m = value.match(data, place + len(name)) if place >= 0 else None
                body = decoded(m[1]) if m else None
                found.append((at if key == b"iv" else m.start(1), m.end(1)) if body is not None and fits(len(body)) else None)
            if all(found):
                out.append((min(a for a, _ in found), max(b for _, b in found)))
            at = data.find(quote + b"iv" + quote, at + 1)
    return out


def vaults(sources: DataFrame) -> DataFrame:
    """(target, needle, offset, match_length) of vaults; the cheap anchor test comes first."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, a, b - a) for t, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b in vault_spans(data)]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32()))], ["target", "offset", "match_length"])

    rows = sources.where(F.col("raw").contains('"iv"') | F.col("raw").contains('\\"iv\\"')).select("target", "data")
    return rows.mapInArrow(spans, "target string, offset bigint, match_length int").select("target", F.lit("metamask-vault").alias("needle"), "offset", "match_length")


def access_keys(sources: DataFrame) -> DataFrame:
    return found(sources, "aws-access-key", ACCESS_KEY, "AKIA")


def tokens(sources: DataFrame) -> DataFrame:
    return found(sources, "github-token", TOKEN, "gh")


def private_key_blocks(sources: DataFrame) -> DataFrame:
    """Blocks whose body is base64; verified if a DER family's body is a SEQUENCE of fitting length. Others don't report."""
    rows = found(sources, "pem-private-key", PEM, "PRIVATE KEY-----")
    body = F.try_to_binary(F.regexp_replace(F.regexp_extract("text", PEM, 2), r"\s", ""), F.lit("base64"))
    rows = rows.withColumn("body", body).where("octet_length(body) > 1")
    digits = F.hex("body")
    short = F.conv(F.substr(digits, F.lit(3), F.lit(2)), 16, 10).cast("int")
    size = F.when(short < 128, short + 2).when(short == 129, F.conv(F.substr(digits, F.lit(5), F.lit(2)), 16, 10).cast("int") + 3).when(
        short == 130, F.conv(F.substr(digits, F.lit(5), F.lit(4)), 16, 10).cast("int") + 4
    )
    der = digits.startswith("30") & F.coalesce(size == F.octet_length("body"), F.lit(False))
    openssh = F.col("text").contains("OPENSSH")
    return rows.where(der | openssh).withColumn("verified", der).drop("body")


def secrets(sources: DataFrame, profile: str) -> DataFrame:
    """The credentials profile: target, needle, offset, match_length, verified; empty under the default profile."""
    keys = access_keys(sources).unionAll(tokens(sources)).withColumn("verified", F.lit(None).cast("boolean"))
    out = keys.unionByName(private_key_blocks(sources)).select("target", "needle", "offset", "match_length", "verified")
    return out if profile == "secrets" else out.where(F.lit(False))


def key_records(sources: DataFrame, least: int = 1000, most: int = 100_000_000) -> DataFrame:
    """66-byte encrypted master-key records at any offset: target, offset, iterations."""
    rows = found(sources, "mkey", RECORD, "\x08", 1)
    digits = F.hex(F.encode(F.substr("text", F.lit(63), F.lit(4)), "ISO-8859-1"))
    little = F.concat(*[F.substr(digits, F.lit(7 - 2 * k), F.lit(2)) for k in range(4)])
    return rows.withColumn("iterations", F.conv(little, 16, 10).cast("bigint")).where(F.col("iterations").between(least, most)).select("target", "offset", "iterations")


KEYSTORE_SCHEMA = (
    "address string, crypto struct<cipher:string,ciphertext:string,cipherparams:struct<iv:string>,kdf:string,"
    "kdfparams:struct<dklen:int,n:bigint,r:bigint,p:bigint,c:bigint,prf:string,salt:string>,mac:string>, version int"
)


def enclosing_objects(raw: str, anchor: str = '"ciphertext"', reach: int = 2048, tries: int = 32) -> list[tuple[int, str]]:
    """(offset, text) of the nearest JSON object around each anchor that has an address and a crypto object: up to
    `tries` opening braces back, within `reach`."""
    out: list[tuple[int, str]] = []
    at = raw.find(anchor)
    while at >= 0:
        start = at
        for _ in range(tries):
            start = raw.rfind("{", max(0, at - reach), start)
            if start < 0:
                break
            try:
                value, size = json.JSONDecoder().raw_decode(raw[start : start + 2 * reach])
            except ValueError:
                continue
            keys = {k.lower() for k in value}
            if {"address", "crypto"} <= keys and start + size > at:
                if not out or out[-1][0] != start:
                    out.append((start, raw[start : start + size]))
                break
        at = raw.find(anchor, at + 1)
    return out


def usable_keystore(text: str) -> bool:
    """Has the object a 40-digit address, a hexadecimal ciphertext, a cipher and a kdf?"""
    value = json.loads(text.lower())
    crypto = value.get("crypto")
    if not isinstance(crypto, dict) or not all(isinstance(crypto.get(k), str) for k in ("ciphertext", "cipher", "kdf")):
        return False
    return bool(re.fullmatch("(0x)?[0-9a-f]{40}", str(value.get("address"))) and re.fullmatch("[0-9a-f]+", crypto["ciphertext"]))


def keystores(sources: DataFrame) -> DataFrame:
    """JSON objects around "ciphertext" with a 40-digit address and a usable cipher and kdf; text is the object."""

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(t, o, x) for t, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for o, x in enclosing_objects(raw)]
            cols = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()))], ["target", "offset", "text"])

    rows = sources.where(F.col("raw").contains('"ciphertext"')).select("target", "raw").mapInArrow(objects, "target string, offset bigint, text string")
    rows = rows.select("target", F.lit("eth-keystore").alias("needle"), "offset", F.length("text").alias("match_length"), "text")
    rows = rows.withColumn("json", F.from_json(F.lower("text"), KEYSTORE_SCHEMA))
    good = F.col("json.address").rlike("^(0x)?[0-9a-f]{40}$") & F.col("json.crypto.ciphertext").rlike("^[0-9a-f]+$") & F.col("json.crypto.cipher").isNotNull() & F.col("json.crypto.kdf").isNotNull()
    return rows.where(F.coalesce(good, F.lit(False)))


def keystore_parameters(stores: DataFrame) -> DataFrame:
    """target, offset, kdf, and the reason for which its parameters can't be used (null if they can)."""
    c, k = "json.crypto", "json.crypto.kdfparams"
    hexes = [F.coalesce(F.col(x).rlike("^([0-9a-f]{2})+$"), F.lit(False)) for x in (f"{c}.ciphertext", f"{c}.mac", f"{k}.salt", f"{c}.cipherparams.iv")]
    positive = lambda *names: F.least(*[F.coalesce(F.col(f"{k}.{n}"), F.lit(0)) for n in names]) > 0
    reason = (
        F.when(F.col(f"{c}.cipher") != "aes-128-ctr", F.lit("cipher"))
        .when(~(hexes[0] & hexes[1] & hexes[2] & hexes[3]), F.lit("hex"))
        .when(F.col(f"{c}.kdf") == "scrypt", F.when(~positive("n", "r", "p"), F.lit("scrypt parameters")))
        .when(F.col(f"{c}.kdf") == "pbkdf2", F.when((F.coalesce(F.col(f"{k}.prf"), F.lit("")) != "hmac-sha256") | ~(F.coalesce(F.col(f"{k}.c"), F.lit(0)) > 0), F.lit("pbkdf2 parameters")))
        .otherwise(F.lit("kdf"))
    )
    return stores.select("target", "offset", F.col(f"{c}.kdf").alias("kdf"), reason.alias("reason"))


# The character sets of descriptor checksums.
DESCRIPTOR_INPUT = "0123456789()[],'/*abcdefgh@:$%{}" + "IJKLMNOPQRSTUVWXYZ&+-.;<=>?!^_|~" + "ijklmnopqrstuvwxyzABCDEFGH`#\"\\ "
DESCRIPTOR_OUTPUT = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
DESCRIPTOR_GENERATORS = [0xF5DEE51989, 0xA9FDCA3312, 0x1BAB10E32D, 0x3706B1677A, 0x644D626FFD]
DESCRIPTOR_END = r"\)#[" + DESCRIPTOR_OUTPUT + r"]{8}(?![" + DESCRIPTOR_OUTPUT + r"])"
_NAME = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]++(?=\()")


def descriptor_checksum(body: str) -> str | None:
    """The 8-character checksum of a descriptor's body; None if it holds other characters than descriptors may."""
    places = [DESCRIPTOR_INPUT.find(x) for x in body]
    if min(places, default=0) < 0:
        return None
    groups = [p >> 5 for p in places]
    values = []
    for i in range(0, len(places), 3):
        values += [p & 31 for p in places[i : i + 3]]
        g = groups[i : i + 3]
        values.append(sum(x * 3 ** (len(g) - 1 - n) for n, x in enumerate(g)))
    c = 1
    for v in values + [0] * 8:
        top, c = c >> 35, (c & 0x7FFFFFFFF) << 5 ^ v
        for n, g in enumerate(DESCRIPTOR_GENERATORS):
            c ^= g if top >> n & 1 else 0
    return "".join(DESCRIPTOR_OUTPUT[(c ^ 1) >> 5 * (7 - n) & 31] for n in range(8))


def _steps_back() -> list[int]:
    """By a sum's last five bits: what to add to the other bits for the sum before a step."""
    out = [0] * 32
    for top in range(32):
        mixed = 0
        for n, g in enumerate(DESCRIPTOR_GENERATORS):
            mixed ^= g if top >> n & 1 else 0
        out[mixed & 31] = top << 35 ^ mixed >> 5
    return out


_BACK = _steps_back()
_BACK_TWO = [(x >> 5 ^ _BACK[x & 31]) >> 5 ^ _BACK[(x >> 5 ^ _BACK[x & 31]) & 31] for x in range(1024)]
_PLACES = {x: n for n, x in enumerate(DESCRIPTOR_INPUT)}
#: What a character adds to the four values of three characters, the group's in the last five bits, by its place in them.
_FIRST, _SECOND, _THIRD = ({x: (p & 31) << 15 - 5 * k | (p >> 5) * 3 ** (2 - k) for x, p in _PLACES.items()} for k in range(3))


def descriptor_fits(body: str, want: str) -> set[int]:
    """All places from which on the rest of body has this checksum. The steps of a checksum can be taken back, from its end to
    the sum before a place, which has to be 1. Characters go by threes, so that a place goes on from the sum before the place
    three later: four steps a character, two at once, however long body is, and nothing kept but three sums."""
    end = 0
    for x in want:
        end = end << 5 | DESCRIPTOR_OUTPUT.index(x)
    end ^= 1
    for _ in range(8):
        end = end >> 5 ^ _BACK[end & 31]
    size, one, two, three, out = len(body), end, end, end, set()
    for s in range(size - 1, -1, -1):
        if body[s] not in _PLACES:
            break
        if s < size - 2:
            c = three ^ _FIRST[body[s]] + _SECOND[body[s + 1]] + _THIRD[body[s + 2]]
            c = c >> 10 ^ _BACK_TWO[c & 1023]
            c = c >> 10 ^ _BACK_TWO[c & 1023]
        else:
            places, group, c = [_PLACES[x] for x in body[s:]], 0, end
            for p in places:
                group = group * 3 + (p >> 5)
            for v in (group, *(p & 31 for p in reversed(places))):
                c = (c ^ v) >> 5 ^ _BACK[(c ^ v) & 31]
        one, two, three = c, one, two
        if c == 1:
            out.add(s)
    return out


def descriptor_start(text: str) -> int:
    """Where the descriptor begins that the checksum at text's end fits: the nearest of all bodies, however many brackets and
    characters they have; -1 if none. A name is all characters of names before its bracket or, if none fits, what follows a
    text that touches it."""
    body, _, want = text.rpartition("#")
    names = [m.span() for m in _NAME.finditer(body)]
    first = names[0][0] if names else len(body)
    fits = {first + s for s in descriptor_fits(body[first:], want) if len(body) - first - s >= 12}
    if not fits:
        return -1
    whole = (a for a, _ in reversed(names) if a in fits)
    return next(whole, next((s for a, b in reversed(names) for s in range(a, b) if s in fits), -1))


def descriptor_spans(raw: str) -> list[tuple[int, int]]:
    """(offset, length) of the descriptors of a text: a body holds no "#", so that each character is in one body at most."""
    out = []
    for m in re.finditer(DESCRIPTOR_END, raw):
        low = raw.rfind("#", 0, m.start()) + 1
        skip = descriptor_start(raw[low : m.end()])
        if skip >= 0:
            out.append((low + skip, m.end() - low - skip))
    return out


def descriptors(sources: DataFrame) -> DataFrame:
    """Checksummed descriptors: target, needle, offset, match_length; the cheap anchor test comes first."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, a, n) for t, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, n in descriptor_spans(data.decode("latin-1"))]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32()))], ["target", "offset", "match_length"])

    rows = sources.where(F.col("raw").contains(")#") & F.col("raw").rlike(DESCRIPTOR_END)).select("target", "data")
    return rows.mapInArrow(spans, "target string, offset bigint, match_length int").select("target", F.lit("descriptor").alias("needle"), "offset", "match_length")
