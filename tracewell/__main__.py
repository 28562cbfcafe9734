"""python -m tracewell MODE ...: scans, sweeps, volumes, reports and follow-ups from the command line.

Exit codes: 0 fine, 1 nothing was covered or an error, 2 wrong use, 3 hits with --fail-on-hit.
"""

from __future__ import annotations

import argparse
import json
import os
import shlex
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import PROFILES, ScanOptions
from .operators import carving, keytext, report, salvage, scan
from .plans.evidence import NEEDLES
from .sources import files, filesystems, sinks, volumes, walk
from .streaming import batch

_EWF, _EWF2 = b"EVF\x09\x0d\x0a\xff\x00", b"EVF2\x0d\x0a\x81\x00"


def _words(path: str | None) -> list[str]:
    if not path:
        return []
    with open(path, encoding="utf-8") as f:
        return f.read().split()


def _options(args: argparse.Namespace) -> ScanOptions:
    return ScanOptions(args.start, args.profile, args.reveal, args.context)


def _sources(spark: SparkSession, path: str) -> DataFrame:
    if path == "-":
        return walk.standard_input(spark, sys.stdin.buffer).withColumn("failed", F.lit(None).cast("string"))
    return walk.read_files(spark.createDataFrame([(os.path.abspath(path),)], "path string"))


def _emit(args: argparse.Namespace, hits: DataFrame, covered: bool) -> int:
    """Prints hits, or writes them as JSON lines, leaves out reviewed ones, and says how the run ended."""
    if args.baseline:
        hits = report.without_baseline(hits, files.read_hits(hits.sparkSession, args.baseline))
    hits = hits.withColumn("description", F.format_string("Found '%s' at %s in 4kB block at byte offset %d", "needle", "target", "block_offset"))
    hits = hits.drop("gaps", "typos", "validating") if not args.reveal else hits
    if args.extract_dir:
        sinks.carve_files(carving.numbered(hits), args.extract_dir).count()
    hits = hits.drop("carve").cache()
    if args.json:
        files.write_hits(hits, args.json, "append" if args.journal else "error")
    else:
        for row in report.ordered(hits).toLocalIterator():
            print(row.description)
    return files.exit_code(hits.count(), args.fail_on_hit, covered)


def _scanned(args: argparse.Namespace, sources: DataFrame) -> DataFrame:
    return scan.scan_all(sources, NEEDLES, _words(args.words), _options(args), carve=bool(args.extract_dir))


def do_scan(spark: SparkSession, args: argparse.Namespace) -> int:
    targets = [r.target for r in files.target_list(spark, args.targets).collect()] if args.targets else args.path
    if not targets:
        raise SystemExit("no target")
    sources = [_sources(spark, t).select("target", "data", "failed").cache() for t in targets]
    failed = [r for s in sources for r in s.where("failed is not null").select("target", "failed").collect()]
    for r in failed:
        print(f"cannot scan {r.target}: {r.failed}", file=sys.stderr)
    if args.journal:
        own = batch.Journal.resumed(args.journal, targets, _options(args)) if args.resume else batch.Journal(args.journal, targets, _options(args))
        by = dict(zip(targets, sources))
        batch.run_batch(targets, lambda t: _emit(args, _scanned(args, by[t]), True) in (0, 3) and by[t].where("failed is not null").isEmpty(), own)
        return 1 if any(r["status"] != "complete" for r in own.rows) else 0
    both = sources[0]
    for s in sources[1:]:
        both = both.unionAll(s)
    return _emit(args, _scanned(args, both), len(failed) < len(targets))


def do_walk(spark: SparkSession, args: argparse.Namespace) -> int:
    own = tuple(x for x in (args.extract_dir, args.json) if x)
    sources, walked = walk.sweep(spark, args.path[0], follow=args.follow, depth=args.depth, own=own)
    sources = sources.cache()
    hits = _scanned(args, sources).withColumn("fingerprint", F.replace("fingerprint", F.lit(os.path.abspath(args.path[0]) + "/"), F.lit("")))
    code = _emit(args, hits, True)
    stats = walk.sweep_statistics(sources, walked, hits)
    print(json.dumps(stats), file=sys.stderr)
    return code if stats["files"] else 1


def _volume_hits(args: argparse.Namespace, windows: DataFrame, by: list[str]) -> DataFrame:
    """One-pass scans of windows; what ends before a window's new bytes was found in the window before."""
    named = windows.withColumn("target", F.to_json(F.struct(*by, "win_offset", "base")))
    hits = scan.scan_all(named, NEEDLES, _words(args.words), _options(args), carve=bool(args.extract_dir))
    key = F.from_json("target", ", ".join(f"{c} {dict(windows.dtypes)[c]}" for c in (*by, "win_offset", "base")))
    hits = hits.withColumn("key", key).where(F.col("offset") + F.col("match_length") + F.col("key.win_offset") > F.col("key.base"))
    moved = [(F.col(c) + F.col("key.win_offset")).alias(c) if c in ("offset", "block_offset") else F.col(c) for c in hits.columns if c not in ("target", "key")]
    return hits.select(*[F.col(f"key.{c}") for c in by], *moved)


def do_fs(spark: SparkSession, args: argparse.Namespace) -> int:
    windows, owners = filesystems.deleted_windows(spark, args.path[0], args.offset)
    hits = _volume_hits(args, windows, ["target", "range_ix"]).join(owners, "range_ix").drop("range_ix")
    return _emit(args, hits, True)


def do_unallocated(spark: SparkSession, args: argparse.Namespace) -> int:
    return _emit(args, _volume_hits(args, filesystems.free_windows(spark, args.path[0], args.offset), ["target"]), True)


def do_report(spark: SparkSession, args: argparse.Namespace) -> int:
    hits = files.read_hits(spark, args.path[0])
    found = sinks.report_json(hits)
    print(json.dumps(found, indent=2) if args.json else sinks.report_text(hits))
    return files.exit_code(found["totals"]["unique_hits"], args.fail_on_hit, True)


def do_dfxml(spark: SparkSession, args: argparse.Namespace) -> int:
    sinks.dfxml(files.read_hits(spark, args.path[0]), args.out)
    return 0


def do_salvage(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = salvage.salvaged(_sources(spark, args.path[0])).collect()
    if not rows:
        print("no database pages that belong together")
        return 0
    own = rows[0].asDict(recursive=True)
    image = own.pop("image")
    if args.out:
        with open(args.out, "wb") as f:
            f.write(image)
        own["path"] = args.out
    print(json.dumps(own, indent=2))
    return 0


def do_watch(spark: SparkSession, args: argparse.Namespace) -> int:
    accounts = keytext.key_hits(_sources(spark, args.path[0])).where(F.col("needle").endswith("pub"))
    text = _sources(spark, args.path[0]).select("target", "raw")
    key = F.substr("raw", (F.col("offset") + 1).cast("int"), F.col("match_length"))
    rows = keytext.watch_addresses(accounts.join(text, "target").select(key.alias("key")).distinct(), args.count)
    if args.out:
        sinks.address_csv(rows, args.out)
    else:
        for r in rows.orderBy("fingerprint", "chain", "index").collect():
            print(r.path, r.address)
    return 0


def do_tokens(spark: SparkSession, args: argparse.Namespace) -> int:
    for r in sinks.token_list(_sources(spark, args.path[0]), args.most).collect():
        print(r.value)
    return 0


def do_verify(spark: SparkSession, args: argparse.Namespace) -> int:
    log = spark.read.json(args.path[0]).select("target", F.col("sha256").alias("logged"), "status")
    now = _sources_of(spark, [r.target for r in log.select("target").distinct().collect()])
    rows = carving.verified(now, log).orderBy("target").collect()
    for r in rows:
        print(r.verdict, r.target)
    return 0 if rows and all(r.verdict == "OK" for r in rows) else 1


def _sources_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = walk.read_files(spark.createDataFrame([(p,) for p in paths], "path string"))
    return rows.where("failed is null").select("target", F.sha2("data", 256).alias("sha256"))


def advice(path: str) -> tuple[str | None, list[str]]:
    """(command or None, reasons): what to run on a path, from its kind, boot sectors, partition table and first kilobyte.
    Nothing is scanned or run; what is ambiguous gets a raw scan."""
    own = lambda mode: f"python -m tracewell {mode} {shlex.quote(path)}"
    if os.path.isdir(path):
        return (own("walk"), [f"{path} is a folder"]) if os.listdir(path) else (None, [f"{path} is an empty folder: nothing to scan"])
    read = volumes.file_reader(path)
    head = read(0, 1024)
    if not head:
        return None, [f"{path} is empty: nothing to scan"]
    if head.startswith(_EWF2):
        return None, [f"{path} is an image of version 2: convert it to a raw one first"]
    if head.startswith(_EWF):
        return own("scan"), [f"{path} is an image of version 1: its chunks are decoded and checked"]
    try:
        found = filesystems.volumes_of(read)
        return own("fs"), [f"{kind} at offset {at}" for at, kind in found] + [f"free space alone: {own('unallocated')}"]
    except ValueError as e:
        why = str(e)
    hits = scan.shape_evidence(head, "default") + scan.key_evidence(head)
    if any(h["needle"].endswith("pub") for h in hits):
        return own("watch"), ["its first kilobyte holds a public account key"]
    return own("scan"), [why, "a raw scan reads every byte; hits have no file names"]


def do_advise(spark: SparkSession | None, args: argparse.Namespace) -> int:
    command, reasons = advice(args.path[0])
    print(json.dumps({"target": args.path[0], "command": command, "reasons": reasons}, indent=2))
    return 0


MODES: dict[str, Callable[[SparkSession, argparse.Namespace], int]] = {
    n.removeprefix("do_"): f for n, f in globals().items() if n.startswith("do_")
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("tracewell", description=__doc__.splitlines()[0])
    out.add_argument("mode", choices=sorted(MODES))
    out.add_argument("path", nargs="*", help="targets; - is standard input")
    out.add_argument("--words", help="a file with a word list, a word a line")
    out.add_argument("--targets", help="a file with a target a line")
    out.add_argument("--profile", default="", choices=PROFILES)
    out.add_argument("--reveal", action="store_true", help="with matched words, and what near misses may be")
    out.add_argument("--json", nargs="?", const="-", help="hits as JSON lines into this folder; for a report, as JSON")
    out.add_argument("--baseline", help="JSON lines of reviewed hits, which are left out")
    out.add_argument("--extract-dir", help="carves go here")
    out.add_argument("--out")
    out.add_argument("--journal")
    for name, kind, default in (("start", int, 0), ("context", int, 4096), ("offset", int, None), ("depth", int, 0), ("count", int, 20), ("most", int, 256)):
        out.add_argument(f"--{name}", type=kind, default=default)
    for name in ("follow", "resume", "fail-on-hit"):
        out.add_argument(f"--{name}", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.path and not args.targets:
        print("a target is needed", file=sys.stderr)
        return 2
    try:
        if args.mode != "advise" and spark is None:
            spark = SparkSession.builder.appName("tracewell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        return MODES[args.mode](spark, args)
    except (OSError, ValueError) as e:
        print(f"{args.mode}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
