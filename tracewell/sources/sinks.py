"""Where results go: DFXML, carve files, reports, case logs, token lists and address tables. Words are never exported."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import token_words
from ..operators import report


def _xml(c: F.Column) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "�")


def dfxml_objects(hits: DataFrame) -> DataFrame:
    """A `fileobject` with one byte run for each hit, as text."""
    body = F.format_string(
        '<fileobject><filename>%s</filename><byte_runs><byte_run img_offset="%d" len="%d"/></byte_runs><label>%s</label></fileobject>',
        _xml(F.col("target")), "offset", "match_length", _xml(F.col("needle")),
    )
    return hits.orderBy("target", "offset", "needle").select(body.alias("value"))


def dfxml(hits: DataFrame, path: str, program: str = "tracewell", version: str = "1") -> None:
    """A DFXML 1.1.1 document: the objects are streamed from the executors a partition at a time."""
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<dfxml xmloutputversion="1.1.1">\n<creator><program>{program}</program><version>{version}</version></creator>\n')
        for row in dfxml_objects(hits).toLocalIterator():
            out.write(row.value + "\n")
        out.write("</dfxml>\n")


def carve_files(carves: DataFrame, folder: str) -> DataFrame:
    """Writes hit-NNNNNN.bin and its .json for each (seq, target, needle, offset, carve) into a folder that executors
    share, each through a temporary name, so that a task run twice leaves the same files. Returns (seq, path)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = []
            for r in batch.to_pylist():
                path = os.path.join(folder, f"hit-{r['seq']:06d}")
                side = {k: r[k] for k in ("target", "needle", "offset")} | {"size": len(r["carve"])}
                for name, data in ((path + ".bin", r["carve"]), (path + ".json", json.dumps(side).encode())):
                    with open(f"{name}.tmp-{os.getpid()}", "wb") as f:
                        f.write(data)
                    os.replace(f"{name}.tmp-{os.getpid()}", name)
                paths.append(path + ".bin")
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(paths, pa.string())], ["seq", "path"])

    return carves.select("seq", "target", "needle", "offset", "carve").mapInArrow(write, "seq long, path string")


def report_json(hits: DataFrame) -> dict:
    """Totals, counts by type, what to pursue, and every unique hit in order: the form for machines leaves nothing out."""
    once = hits.dropDuplicates(["target", "needle", "offset"])
    return {
        "totals": report.totals(hits).first().asDict(),
        "types": {r.type: r.hits for r in report.counts(once).collect()},
        "playbook": report.steps(once),
        "hits": [[r.target, r.offset, r.needle] for r in report.ordered(once).toLocalIterator()],
        "coverage_note": COVERAGE,
    }


def report_text(hits: DataFrame, most: int = 50) -> str:
    """The form for readers: totals, types, steps and the first `most` hits, with how many more there are."""
    once = hits.dropDuplicates(["target", "needle", "offset"])
    total = report.totals(hits).first()
    first = report.ordered(once).limit(most).collect()
    lines = [f"{total.total} hits, {total.unique_hits} unique, {total.duplicates} repeated, in {total.targets} targets"]
    lines += [f"  {r.type}: {r.hits}" for r in report.counts(once).orderBy("type").collect()] + [f"* {x}" for x in report.steps(once)]
    lines += [f"{r.target} @{r.offset} {r.needle}" for r in first] + ([f"... and {total.unique_hits - len(first)} more"] if total.unique_hits > len(first) else [])
    return "\n".join([*lines, COVERAGE])


COVERAGE = "absence of a hit isn't absence of a trace: only what was read was scanned"


def case_log(sources: DataFrame, skipped: DataFrame | None, path: str) -> None:
    """Appends a record per target: size, SHA-256 and MD5 of its bytes, skipped ranges, and complete or partial."""
    rows = sources.select("target", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256"), F.md5("data").alias("md5"))
    if skipped is not None:
        gaps = skipped.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("start", "len"))).alias("skipped"))
        rows = rows.join(gaps, "target", "left")
    else:
        rows = rows.withColumn("skipped", F.lit(None).cast("array<struct<start:bigint,len:bigint>>"))
    rows = rows.withColumn("status", F.when(F.col("skipped").isNull(), "complete").otherwise("partial"))
    rows.write.mode("append").json(path)


def token_list(sources: DataFrame, most: int = 256) -> DataFrame:
    """The first `most` distinct tokens in the order in which they stand, with characters that matter to token files escaped."""
    if not 0 < most <= 100_000:
        raise ValueError("a token list has 1 to 100,000 tokens")
    rows = sources.select("target", F.posexplode(token_words(F.col("raw"))).alias("at", "token"))
    first = rows.groupBy("token").agg(F.min(F.struct("target", "at")).alias("first")).orderBy("first", "token").limit(most)
    return first.select(F.regexp_replace("token", r"([\[\]^$+*?\\%])", r"\\$1").alias("value"))


def address_csv(addresses: DataFrame, path: str) -> None:
    """The fixed header fingerprint,version,chain,index,path,address,script,balance_sats."""
    named = addresses if "balance_sats" in addresses.columns else addresses.withColumn("balance_sats", F.lit(None).cast("bigint"))
    named.select("fingerprint", "version", "chain", "index", "path", "address", "script", "balance_sats").write.option("header", True).csv(path)
