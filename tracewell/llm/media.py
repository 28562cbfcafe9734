"""Media columns: AVI motion-JPEG held in a binary column.

``write_avi`` and ``read_avi`` build and parse the RIFF form with its ``idx1`` index. Frames are intra-coded JPEGs.
For lossless storage of bytes the frames use the lossless process of ITU-T T.81 (SOF3, predictor 1, 8-bit samples) with
the standard luminance table, left out of the frames as motion-JPEG does; ``decode_baseline`` reads the usual DCT
frames. Lossless frames are coded and decoded in lockstep: one numpy step handles the same sample of every frame held.

Shots are found by the L1 difference of grey histograms between neighbouring frames against an adaptive threshold: the
mean and deviation of the differences in a window around the frame. ``clips`` turns a media column into timed rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import documents, short_batches

SIDE, UNIT, FPS, SLAB = 24, 576, 25, 2048

# The standard Huffman tables of ITU-T T.81, K.3 to K.6 (codes per length, symbols).
DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
AC_LUMA = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], list(bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa")))  # fmt: skip
AC_CHROMA = ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], list(bytes.fromhex(
    "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa")))  # fmt: skip
STANDARD = {0x00: DC_LUMA, 0x01: DC_CHROMA, 0x10: AC_LUMA, 0x11: AC_CHROMA}


def huffman(table: tuple[list[int], list[int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[table[1][k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length for each difference -255..255 (index +255) of the lossless process."""
    table = huffman(DC_LUMA)
    code, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = table[size]
        code[d + 255] = c << size | ((d if d > 0 else d + (1 << size) - 1) if size else 0)
        length[d + 255] = n + size
    return code, length


CODE, LENGTH = _difference_codes()


def _peek_tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference and bits used for each 16 leading bits; the longest code with its extra bits has 14."""
    value, used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
    for d in range(-255, 256):
        n = int(LENGTH[d + 255])
        a = int(CODE[d + 255]) << 16 - n
        value[a : a + (1 << 16 - n)], used[a : a + (1 << 16 - n)] = d, n
    return value, used


PEEK_VALUE, PEEK_USED = _peek_tables()


def jpeg_head(width: int, height: int) -> bytes:
    return b"\xff\xd8\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, height, width, 1, 1, 0x11, 0) + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)


def encode_lossless(frames: np.ndarray) -> list[bytes]:
    """One lossless JPEG for each frame of an (n, height, width) array of bytes."""
    n, height, width = frames.shape
    x = frames.astype(np.int64)
    before = np.empty_like(x)
    before[:, :, 1:] = x[:, :, :-1]
    before[:, 1:, 0] = x[:, :-1, 0]
    before[:, 0, 0] = 128
    d = (x - before + 255).reshape(n, -1)
    bits = LENGTH[d]
    ends = np.cumsum(bits, 1)
    size = (ends[:, -1] + 7) // 8
    first = np.cumsum(size) - size
    at = ends - bits + first[:, None] * 8
    value = CODE[d] << 24 - (at & 7) - bits
    byte = (at >> 3).ravel()
    total = int(size.sum())
    out = np.zeros(total + 3)
    for k in range(3):
        out += np.bincount(byte + k, (value >> 16 - 8 * k & 255).ravel(), total + 3)
    data = out[:total].astype(np.uint8)
    data[first + size - 1] |= ((1 << size * 8 - ends[:, -1]) - 1).astype(np.uint8)
    stuffed = np.flatnonzero(data == 255)
    data = np.insert(data, stuffed + 1, 0)
    cut = np.append(first, total)
    cut = cut + np.searchsorted(stuffed, cut)
    raw, head = data.tobytes(), jpeg_head(width, height)
    cut = cut.tolist()
    return [head + raw[a:b] + b"\xff\xd9" for a, b in zip(cut, cut[1:])]


def decode_lossless(jpegs: list[bytes], width: int, height: int) -> np.ndarray:
    """The frames back, in lockstep; every JPEG must have the head that encode_lossless writes for this size."""
    head = jpeg_head(width, height)
    if any(not (j.startswith(head) and j.endswith(b"\xff\xd9")) for j in jpegs):
        raise ValueError("a frame isn't lossless JPEG of this size with the standard table")
    sizes = np.fromiter((len(j) - len(head) - 2 for j in jpegs), np.int64, len(jpegs))
    data = np.frombuffer(b"".join(j[len(head) : -2] for j in jpegs), np.uint8)
    stuffing = np.flatnonzero((data[1:] == 0) & (data[:-1] == 255)) + 1
    start = np.cumsum(sizes) - sizes
    start = start - np.searchsorted(stuffing, start)
    data = np.append(np.delete(data, stuffing), np.zeros(4, np.uint8)).astype(np.uint32)
    wide = data[:-3] << np.uint32(16) | data[1:-2] << np.uint32(8) | data[2:-1]
    at = start * 8
    diff = np.empty((width * height, len(jpegs)), np.int32)
    for k in range(width * height):
        peek = wide[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & np.uint32(0xFFFF)
        diff[k] = PEEK_VALUE[peek]
        at += PEEK_USED[peek]
    x = np.ascontiguousarray(diff.T).reshape(-1, height, width)
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], 1)
    return (np.cumsum(x, 2) & 255).astype(np.uint8)


def decode_baseline(jpeg: bytes) -> np.ndarray:
    """Grey samples (height, width) of a baseline DCT JPEG (SOF0), with restart intervals, any sampling, and the
    standard tables where a frame, as in motion-JPEG, has none. Only the first component is kept."""
    quant: dict[int, np.ndarray] = {}
    tables = {k: peeks(huffman(t)) for k, t in STANDARD.items()}
    at, restart, parts, height, width = 2, 0, [], 0, 0
    scan = []
    while at < len(jpeg):
        marker, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(float)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0]] = peeks(huffman((counts, list(body[17 : 17 + sum(counts)]))))
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            height, width, k = struct.unpack_from(">HHB", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"JPEG process {marker:#x} isn't read")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    if not parts or not scan:
        raise ValueError("a frame without a scan")
    tail = re.search(rb"\xff[^\x00\xd0-\xd7]", jpeg[at:], re.S)
    pieces = re.split(rb"\xff[\xd0-\xd7]", jpeg[at : at + tail.start()] if tail else jpeg[at:])
    wave = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 8**-0.5) for u in range(8)] for x in range(8)])
    high_h, high_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * high_h)), -(-height // (8 * high_v))
    if across * down * sum(p[1] * p[2] for p in parts) * 2 > 8 * (len(jpeg) - at):  # a block has two codes, of a bit at least
        raise ValueError("a frame claims more blocks than its bytes can hold")
    out, order = np.zeros((down * 8 * parts[0][2], across * 8 * parts[0][1])), zigzag()
    data, pos = b"", 0

    def symbol(table: tuple[list[int], list[int]]) -> int:
        nonlocal pos
        peek = int.from_bytes(data[pos >> 3 : (pos >> 3) + 3]) >> 8 - (pos & 7) & 0xFFFF
        if not table[0][peek]:
            raise ValueError("no such Huffman code")
        pos += table[0][peek]
        return table[1][peek]

    def signed(n: int) -> int:
        nonlocal pos
        v = int.from_bytes(data[pos >> 3 : (pos >> 3) + 3]) >> 24 - (pos & 7) - n & (1 << n) - 1
        pos += n
        return v if not n or v >> n - 1 else v - (1 << n) + 1

    dc = [0] * len(parts)
    for m in range(across * down):
        if m == 0 or restart and m % restart == 0:
            if not pieces:
                raise ValueError("a frame ends before its last restart")
            data, pos, dc = pieces.pop(0).replace(b"\xff\0", b"\xff") + b"\xff\xff\xff", 0, [0] * len(parts)
        if pos >> 3 > len(data):
            raise ValueError("a frame ends before its last block")
        for i, (part, (_, dc_id, ac_id)) in enumerate(zip(parts, scan)):
            for v in range(part[2]):
                for h in range(part[1]):
                    block = np.zeros(64)
                    dc[i] += signed(symbol(tables[dc_id]))
                    block[0], k = dc[i], 1
                    while k < 64:
                        s = symbol(tables[16 + ac_id])
                        if not s:
                            break
                        k += s >> 4
                        if s & 15:
                            block[order[k]] = signed(s & 15) * quant[part[3]][k]
                        k += 1
                    if i == 0:
                        block[0] *= quant[part[3]][0]
                        y, x = (m // across * part[2] + v) * 8, (m % across * part[1] + h) * 8
                        out[y : y + 8, x : x + 8] = wave @ block.reshape(8, 8) @ wave.T
    return np.clip(np.rint(out[:height, :width] + 128), 0, 255).astype(np.uint8)


def peeks(table: dict[int, tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Length (0: none) and symbol of the code that the next 16 bits begin with."""
    used, value = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in table.items():
        used[code << 16 - n : code + 1 << 16 - n], value[code << 16 - n : code + 1 << 16 - n] = n, s
    return used.tolist(), value.tolist()


def zigzag() -> list[int]:
    """Raster place of each coefficient in zigzag order."""
    return sorted(range(64), key=lambda i: ((s := i // 8 + i % 8), i // 8 if s % 2 else i % 8))


def write_avi(jpegs: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    most = max(map(len, jpegs), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(jpegs), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, len(jpegs), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    size = np.fromiter(map(len, jpegs), np.int64, len(jpegs))
    step = 8 + size + (size & 1)
    index = np.zeros(len(jpegs), np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, 4 + np.cumsum(step) - step, size
    movi = b"movi" + b"".join(chunk(b"00dc", j) for j in jpegs)
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", movi) + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(avi: bytes) -> tuple[list[bytes], int, int, float]:
    """(frames, width, height, frames a second), the frames found by the file's index, or by a walk without one."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    width = height = 0
    fps, movi, index, at = float(FPS), None, None, 12
    while at + 8 <= len(avi):
        name, n = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST" and avi[at + 8 : at + 12] == b"hdrl":
            micro, width, height = struct.unpack_from("<I28xII", avi, at + 20)
            fps = 1e6 / micro if micro else fps
        elif name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = (at + 8, n)
        elif name == b"idx1":
            index = np.frombuffer(avi, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), n // 16, at + 8)
        at += 8 + n + (n & 1)
    if movi is None:
        raise ValueError("an AVI file without frames' list")
    if index is not None:
        video = index[(index["id"] == b"00dc") | (index["id"] == b"00db")]
        base = movi[0] if not len(video) or avi[movi[0] + int(video["at"][0]) : movi[0] + int(video["at"][0]) + 4] in (b"00dc", b"00db") else 0
        return [avi[base + a + 8 : base + a + 8 + n] for a, n in zip(video["at"].tolist(), video["size"].tolist())], width, height, fps
    out, at = [], movi[0] + 4
    while at + 8 <= movi[0] + movi[1]:
        n = struct.unpack_from("<I", avi, at + 4)[0]
        if avi[at : at + 4] in (b"00dc", b"00db"):
            out.append(avi[at + 8 : at + 8 + n])
        at += 8 + n + (n & 1)
    return out, width, height, fps


def frames_of(avi: bytes) -> tuple[np.ndarray, float]:
    """Grey frames (n, height, width) and frames a second."""
    jpegs, width, height, fps = read_avi(avi)
    if not jpegs:
        return np.zeros((0, height, width), np.uint8), fps
    if jpegs[0].startswith(jpeg_head(width, height)):
        return np.concatenate([decode_lossless(jpegs[a : a + SLAB], width, height) for a in range(0, len(jpegs), SLAB)]), fps
    return np.stack([decode_baseline(j) for j in jpegs]), fps


def shots(frames: np.ndarray, bins: int = 16, reach: int = 12, strict: float = 3.0, least: float = 0.25) -> list[tuple[int, int]]:
    """[first, last) frames of each shot. A cut lies before a frame whose histogram differs from the one before by over
    `least` (of 2) and by over mean + strict * deviation of the differences within `reach` frames, itself left out."""
    n = len(frames)
    if n == 0:
        return []
    flat = frames.reshape(n, -1)
    which = (flat >> np.uint8(8 - (bins - 1).bit_length())).astype(np.int64) + np.arange(n)[:, None] * bins
    hist = np.bincount(which.ravel(), minlength=n * bins).reshape(n, bins)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / flat.shape[1]
    at = np.arange(len(diff))
    lo, hi = np.maximum(at - reach, 0), np.minimum(at + reach + 1, len(diff))
    one, two = (np.concatenate([[0.0], np.cumsum(x)]) for x in (diff, diff**2))
    count = np.maximum(hi - lo - 1, 1)
    mean = (one[hi] - one[lo] - diff) / count
    deviation = np.sqrt(np.maximum((two[hi] - two[lo] - diff**2) / count - mean**2, 0))
    cuts = np.flatnonzero((diff > least) & (diff > mean + strict * deviation)) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges, edges[1:]))


def clips(media: DataFrame, key: str, column: str) -> DataFrame:
    """A row per shot: key, clip (from 0), first_frame, n_frames, start_s, end_s, error.

    Null media have no rows; bytes that can't be read give one row with clip null and the error. Repeated rows give
    repeated clips; other columns are ignored.
    """
    kind = dict(media.dtypes)[key]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0), []
            for i, avi in enumerate(batch.column(1).to_pylist()):
                if avi is None:
                    continue
                try:
                    frames, fps = frames_of(avi)
                    out += [(i, k, a, b - a, a / fps, b / fps, None) for k, (a, b) in enumerate(shots(frames))]
                except (ValueError, IndexError, KeyError, TypeError, ZeroDivisionError, MemoryError, struct.error) as e:
                    out.append((i, None, None, None, None, None, str(e)[:200]))
            cols = list(zip(*out)) or [[]] * 7
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int64()))] + [pa.array(c, t) for c, t in zip(cols[1:], types)], ["key", "clip", "first_frame", "n_frames", "start_s", "end_s", "error"])

    return media.select(F.col(key).alias("key"), F.col(column).alias("media")).mapInArrow(
        found, f"key {kind}, clip int, first_frame long, n_frames long, start_s double, end_s double, error string"
    ).withColumnRenamed("key", key)


def store(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Each text as a lossless motion-JPEG AVI, read back: the columns of op9, and the media itself if with_media.

    Null text is empty, which is one unit of filling; a text of any length becomes frames of 24 x 24 bytes, coded some
    thousand at a time. Rows are independent: repeated rows, null ids and an empty table need nothing special.
    """

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.chunks(batches, "text", 1 << 20):
            raw, at = kernels.utf8(batch.column("text"))
            size = np.diff(at)
            units = np.maximum(-(-size // UNIT), 1)
            first = np.cumsum(units) - units
            payload = np.full(int(units.sum()) * UNIT, 255, np.uint8)
            payload[np.arange(len(raw)) + np.repeat(first * UNIT - at[:-1], size)] = raw
            frames = payload.reshape(-1, SIDE, SIDE)
            jpegs = [j for a in range(0, len(frames), SLAB) for j in encode_lossless(frames[a : a + SLAB])]
            media = [write_avi(jpegs[a : a + n], SIDE, SIDE) for a, n in zip(first.tolist(), units.tolist())]
            found = [read_avi(m)[0] for m in media]  # the frames as the stored bytes' own index gives them
            back = [j for x in found for j in x]
            seen = np.concatenate([decode_lossless(back[a : a + SLAB], SIDE, SIDE) for a in range(0, len(back), SLAB)])
            edges, rows = np.cumsum([0, *map(len, found)]).tolist(), []
            for i, m in enumerate(media):
                own = seen[edges[i] : edges[i + 1]]
                data, cut = own.tobytes(), shots(own)
                feature = f"{len(own)} frames, {len(cut)} shots from " + ",".join(f"{a / FPS:.2f}" for a, _ in cut)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [batch.column("doc_id"), pa.array(size, pa.int64())] + [pa.array(c, t) for c, t in zip(cols, kinds)]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if with_media:
                arrays.append(pa.array(media, pa.binary()))
                names.append("media")
            yield pa.RecordBatch.from_arrays(arrays, names)

    short_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(stored, schema + (", media binary" if with_media else ""))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(documents(spark, sf_dir))


QUERIES = {"op9_media_columns": op9_media_columns}
ORACLE: dict[str, str] = {}
