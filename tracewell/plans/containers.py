"""Queries over key text, archives and database pages, on evidence made from the documents."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import check_encode
from ..functions.scalars import latin
from ..operators import keytext, salvage
from ..sources import archives

KEYS = [
    ("wif", check_encode(b"\x80" + bytes(range(1, 33)))),
    ("wif", check_encode(b"\x80" + bytes(range(2, 34)) + b"\x01")),
    ("wif-testnet", check_encode(b"\xef" + bytes(range(3, 35)))),
    ("xpub", check_encode(bytes.fromhex("0488b21e") + bytes(9) + bytes(range(32)) + b"\x02" + bytes(range(4, 36)))),
    ("zprv", check_encode(bytes.fromhex("04b2430c") + bytes(9) + bytes(range(32)) + b"\0" + bytes(range(5, 37)))),
]
#: Public accounts of the published derivation vectors.
ACCOUNTS = [
    "zpub6rFR7y4Q2AijBEqTUquhVz398htDFrtymD9xYYfG1m4wAcvPhXNfE3EfH1r1ADqtfSdVCToUG868RvUUkgDKf31mGDtKsAYz2oz2AGutZYs",
    "xpub661MyMwAqRbcFtXgS5sYJABqqG9YLmC4Q1Rdap9gSE8NqtwybGhePY2gZ29ESFjqJoCu1Rupje8YtGqsefD265TMg7usUDFdp6W1EGMcet8",
]


def base58_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = F.element_at(F.array(*[F.lit(k) for _, k in KEYS]), (F.col("doc_id") % len(KEYS) + 1).cast("int"))
    data = F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), key, F.lit("0 end")), "UTF-8")
    return keytext.key_hits(docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("target"), latin(data).alias("raw")))


def watch_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keytext.watch_addresses(spark.createDataFrame([(k,) for k in ACCOUNTS], "key string"), 20)


def _boxed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                data, box = (text or "").encode(), io.BytesIO()
                if kind == "gzip":
                    data = b"junk" * 3000 + gzip.compress(data, 0, mtime=0) + b"junk"  # the zip packs it, so that it doesn't show through
                with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(zipfile.ZipInfo("a/text"), data, zipfile.ZIP_DEFLATED)
                out.append(b"lead" + box.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("target"), pa.array(out, pa.binary())], ["target", "data"])

    return run


def _archives(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("target"), "text")
    members = archives.expand(docs.mapInArrow(_boxed(kind), "target string, data binary"), 2)
    return members.where(F.col("kind") == kind).select(F.substring_index("target", "!", 1).alias("target"), "depth", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256"))


def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archives(spark, sf_dir, "zip")


def gzip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archives(spark, sf_dir, "gzip")


def page_image(number: int) -> bytes:
    """Eight shuffled 512-byte pages of one database, with junk between, and one of another."""
    out = bytearray(number % 37)
    for k in range(8):
        pgno = (k * 5 + number) % 8
        page = struct.pack("<IIIII", 7, 0, pgno, 0x053162, 9) + struct.pack("<I", 512)
        out += page.ljust(512, bytes([65 + pgno]))
        out += b"." * (number % 3 * 4)
    return bytes(out) + struct.pack("<IIIII", 8, 0, 1, 0x061561, 9).ljust(512, b"x")


def _page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"img-{i}" for i in ids]), pa.array([page_image(i) for i in ids], pa.binary())], ["target", "data"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return docs.mapInArrow(build, "target string, data binary")


def salvage_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salvage.pages(_page_images(spark, sf_dir))


def salvage_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image put together from each source's pages, with its runs and what speaks against opening it."""
    rows = salvage.salvaged(_page_images(spark, sf_dir))
    return rows.select("target", "kind", "page_size", F.size("pages").alias("n_pages"), F.size("runs").alias("n_runs"), "complete", "ordered", "verdict", F.size("reasons").alias("n_reasons"), F.sha2("image", 256).alias("image_sha256"))


QUERIES = {f.__name__: f for f in (base58_keys, watch_addresses, zip_members, gzip_members, salvage_pages, salvage_images)}
_KEY = f"[{', '.join(f'''struct_pack(n := '{n}', k := '{k}')''' for n, k in KEYS)}]"
ORACLE = {
    "base58_keys": f"""with e as (select 'doc-' || doc_id as target, coalesce(text, '') || ' ' as text, ({_KEY})[(doc_id % {len(KEYS)} + 1)::int] as v from documents)
      select target, v.n as needle, octet_length(encode(text))::bigint as "offset", length(v.k)::int as match_length from e""",
    "zip_members": "select 'doc-' || doc_id as target, 1 as depth, octet_length(encode(coalesce(text, '')))::bigint as size, sha256(coalesce(text, '')) as sha256 from documents",
    "gzip_members": "select 'doc-' || doc_id as target, 2 as depth, octet_length(encode(text))::bigint as size, sha256(text) as sha256 from documents where text <> ''",
    "salvage_pages": """with k as (select doc_id, unnest(range(0, 8)) as k from documents)
      select 'img-' || doc_id as target, ((k * 5 + doc_id) % 8)::bigint as pgno, (doc_id % 37 + k * (512 + doc_id % 3 * 4))::bigint as "offset", 512::bigint as page_size from k""",
    "salvage_images": """with p as (select doc_id, unnest(range(0, 8)) as n from documents),
      b as (select doc_id, string_agg('0700000000000000' || lpad(hex(n), 2, '0') || '000000' || '62310500' || '09000000' || '00020000' || repeat(hex(65 + n), 488), '' order by n) as x from p group by 1)
      select 'img-' || doc_id as target, 'bdb' as kind, 512::int as page_size, 8::int as n_pages, (case when doc_id % 3 = 0 then (select count(*) from range(8) t(k) where k = 0 or (k * 5 + doc_id) % 8 <> ((k - 1) * 5 + doc_id + 1) % 8) else 8 end)::int as n_runs,
        true as complete, true as ordered, 'suspect' as verdict, 1::int as n_reasons, sha256(from_hex(x)) as image_sha256 from b""",
}
