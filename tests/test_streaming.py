"""A stream of landed files gives each hit once, also over a restart; the manifest proves what is done."""

import pyspark.sql.functions as F
import pytest

from tracewell.sources.files import read_hits, target_list, whole_files, write_hits
from tracewell.streaming.scan import manifest, scan_stream, unfinished


def test_stream_is_exactly_once(spark, tmp_path):
    land, out, mark = (str(tmp_path / x) for x in ("land", "out", "mark"))
    (tmp_path / "land").mkdir()
    for k in range(3):
        (tmp_path / "land" / f"f{k}").write_bytes(b"." * 4090 + b"bestblock" + b" hdseed" * k)
        scan_stream(spark, land, out, mark).awaitTermination()
    rows = spark.read.parquet(out).groupBy("needle").count().collect()
    assert {r.needle: r["count"] for r in rows} == {"bestblock": 3, "hdseed": 3}
    own = whole_files(spark, land)
    done = manifest(own)
    assert unfinished(own, done).count() == 0
    changed = own.withColumn("data", F.when(F.col("target").endswith("f1"), F.encode(F.lit("new"), "UTF-8")).otherwise(F.col("data")))
    assert unfinished(changed, done).count() == 1


def test_hits_round_trip_and_fail_fast(spark, tmp_path):
    line = '{"description":"d","needle":"bestblock","offset":5,"target":"t","block_offset":0,"match_length":9}'
    (tmp_path / "h.jsonl").write_text(line + "\n")
    hits = read_hits(spark, str(tmp_path / "h.jsonl"))
    write_hits(hits, str(tmp_path / "again"))
    assert spark.read.text(str(tmp_path / "again")).first().value == line
    (tmp_path / "bad.jsonl").write_text(line + "\n{broken\n")
    with pytest.raises(Exception):
        read_hits(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "list").write_text("# no\n\n a\nb\n")
    assert {r.target for r in target_list(spark, str(tmp_path / "list")).collect()} == {"a", "b"}
