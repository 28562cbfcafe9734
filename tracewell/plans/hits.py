"""Queries over literal hits: the scan, the report, the baseline, fingerprints and carves; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import carving, intervals, literals, report
from .evidence import EVIDENCE_SQL, NEEDLES, viewed

_LIST = ", ".join(f"'{n}'" for n in NEEDLES)
HITS_SQL = f"""{EVIDENCE_SQL},
parts as (
  select target, body, needle, string_split(body, needle) as p from evidence, (select unnest([{_LIST}]) as needle) where contains(body, needle)),
hits as (
  select target, needle, (list_sum(list_transform(p[1:i], lambda x: octet_length(encode(x)))) + (i - 1) * length(needle))::bigint as "offset", length(needle)::int as match_length
  from (select *, unnest(range(1, len(p))) as i from parts)),
blocked as (select *, (("offset" + match_length - 1) // 4096 * 4096)::bigint as block_offset from hits)"""


def _class_sql(column: str) -> str:
    """case expressions for type, confidence and encrypted, from the same table as the columns'."""
    kinds = [f"when {column} in ({', '.join(repr(n) for n in names)}) then struct_pack(type := '{k}', confidence := '{c}', encrypted := {e})" for names, k, c, e in scalars.CLASSES]
    return f"case {' '.join(kinds)} else struct_pack(type := 'unknown', confidence := 'low', encrypted := false) end"


CLASS_SQL = _class_sql("needle").replace("True", "true").replace("False", "false")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals.literal_hits(viewed(spark, sf_dir), NEEDLES)


def needle_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir)


def needle_block_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals.first_in_block(hits(spark, sf_dir)).select("target", "needle", "block_offset", "offset", "match_length")


def from_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that skips 1,000 bytes: the block grid starts there."""
    return literals.literal_hits(viewed(spark, sf_dir), NEEDLES, 1000)


def human_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals.describe(hits(spark, sf_dir)).select("description")


def classify_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.classified(hits(spark, sf_dir)).select("target", "offset", "needle", "type", "confidence", "encrypted")


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as three overlapping runs report them, every hit by some of them; seq orders the reports. One scan serves all."""
    runs = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: (k == 3) | (F.col("offset") % (k + 1) == 0))
    return hits(spark, sf_dir).withColumn("seq", F.explode(runs))


def report_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.unique_hits(repeated(spark, sf_dir), [F.col("seq")]).select("target", "needle", "offset", "seq")


def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(repeated(spark, sf_dir))


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts(hits(spark, sf_dir))


def report_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.spans(hits(spark, sf_dir))


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 hits in report order."""
    return report.ordered(hits(spark, sf_dir)).limit(50).select("target", "offset", "needle")


def playbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.playbook(hits(spark, sf_dir))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literals.literal_hits(viewed(spark, sf_dir), NEEDLES, keep=("raw",))
    line = F.encode(scalars.match_line(F.col("raw"), F.col("offset"), F.col("match_length")), "ISO-8859-1")
    return rows.select("target", "needle", "offset", scalars.fingerprint(F.col("target"), F.col("needle"), line).alias("fingerprint"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)


def baseline_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits left when those of every third document are reviewed."""
    marked = _marked(spark, sf_dir)
    reviewed = marked.where("cast(substr(target, 5) as bigint) % 3 = 0").select("fingerprint")
    return report.without_baseline(marked, reviewed).select("target", "needle", "offset")


def carve_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 bytes around each hit, in hex."""
    rows = literals.literal_hits(viewed(spark, sf_dir), NEEDLES, keep=("data",))
    return carving.carved(rows, 64).select("target", "needle", "offset", F.lower(F.hex("carve")).alias("carve_hex"))


def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carving.statistics(viewed(spark, sf_dir))


def carve_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """magic_offset is -1 where no magic is near."""
    rows = carving.classes(literals.literal_hits(viewed(spark, sf_dir), NEEDLES, keep=("data",)))
    return rows.select("target", "needle", "offset", "class", F.coalesce("magic_offset", F.lit(-1)).alias("magic_offset"), "entropy_bits")


def source_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewed(spark, sf_dir).select("target", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256"), F.md5("data").alias("md5"))


def verify_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case log of every target but each 11th, one in seven of them with another digest, against the sources."""
    now = source_hashes(spark, sf_dir)
    number = F.expr("cast(substr(target, 5) as bigint)")
    log = now.where(number % 11 != 0).select("target", F.when(number % 7 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("logged"), F.when(number % 13 == 0, F.lit("canceled")).otherwise(F.lit("complete")).alias("status"))
    return carving.verified(now, log)


def sweep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on a sweep: files, files with a hit, hits, bytes."""
    sources = viewed(spark, sf_dir).select("target", F.octet_length("data").alias("size"))
    per = hits(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n"))
    return sources.join(per, "target", "left").agg(
        F.count("*").alias("files"), F.count("n").alias("files_with_hits"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("hits"), F.sum("size").cast("bigint").alias("bytes")
    )


def asof_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit's owner among ranges of 1,000 bytes, every fourth of which has none."""
    sources = viewed(spark, sf_dir).select("target", F.octet_length("data").alias("size"))
    ranges = sources.select("target", F.explode(F.sequence(F.lit(0), F.expr("size div 1000"))).alias("k")).where("k % 4 != 1")
    return intervals.owner(hits(spark, sf_dir), ranges.select("target", (F.col("k") * 1000).cast("bigint").alias("start"), F.col("k").cast("bigint").alias("owner")))


def first_per_needle(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.expr("cast(substr(target, 5) as bigint)")
    return intervals.first_of(hits(spark, sf_dir).withColumn("doc", number), ["needle"], [F.col("doc"), F.col("offset")]).select("needle", "target", "offset")


def carve_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carving.numbered(hits(spark, sf_dir)).select("seq", "target", "needle", "offset")


QUERIES = {
    f.__name__: f
    for f in (
        needle_hits, needle_block_first, from_offset, human_text, classify_hits, report_dedupe, report_totals, report_counts, report_spans, report_order, playbook,
        fingerprints, baseline_anti, carve_bytes, entropy, carve_class, source_hashes, verify_log, sweep_stats, asof_owner, first_per_needle, carve_numbers,
    )
}
_HEX = """{0},
hexed as (
  select h.target, needle, "offset", match_length, hex(encode(body)) as raw from hits h join evidence e on e.target = h.target)"""
_LINE = r"""{0},
hexed as (
  select h.target, needle, "offset", match_length, hex(encode(body)) as raw from hits h join evidence e on e.target = h.target),
lined as (
  select target, needle, "offset",
    list_reverse(regexp_extract_all(substr(raw, (2 * greatest("offset" - 4096, 0) + 1)::int, (2 * (least("offset", 4096) + 1))::int), '..')) as back,
    substr(raw, (2 * ("offset" + 1) + 1)::int, 2 * (match_length - 1)) as own,
    regexp_extract_all(substr(raw, (2 * ("offset" + match_length) + 1)::int, 2 * 8192), '..') as ahead
  from hexed),
marked as (
  select target, needle, "offset", 'v1/' || target || '/' || needle || '/' || left(sha256(from_hex(
    array_to_string(list_reverse(back[1:coalesce(list_position(back, '0A') - 1, len(back))]), '') || own
    || array_to_string(ahead[1:coalesce(list_position(ahead, '0A') - 1, len(ahead))], ''))), 16) as fingerprint
  from lined)""".format(HITS_SQL)
_STATS = f"""{EVIDENCE_SQL},
bytes as (select target, unnest(regexp_extract_all(hex(encode(body)), '..')) as b from evidence),
counted as (select target, b, count(*) as n from bytes group by 1, 2),
summed as (select target, sum(n) as total, sum(case when b in ('09', '0A', '0D') or b between '20' and '7E' then n else 0 end) as printable from counted group by 1)"""
ORACLE = {
    "needle_hits": f'with {HITS_SQL} select target, needle, "offset", block_offset, match_length from blocked',
    "needle_block_first": f'with {HITS_SQL} select target, needle, block_offset, min("offset") as "offset", first(match_length) as match_length from blocked group by 1, 2, 3',
    "from_offset": f'with {HITS_SQL} select target, needle, "offset", (("offset" + match_length - 1001) // 4096 * 4096 + 1000)::bigint as block_offset, match_length from hits where "offset" >= 1000',
    "human_text": f"with {HITS_SQL} select 'Found ''' || needle || ''' at ' || target || ' in 4kB block at byte offset ' || block_offset as description from blocked",
    "classify_hits": f'with {HITS_SQL}, c as (select *, {CLASS_SQL} as k from hits) select target, "offset", needle, k.type as type, k.confidence as confidence, k.encrypted as encrypted from c',
    "report_dedupe": f'with {HITS_SQL}, r as (select *, unnest([1, 2, 3]) as k from hits) select target, needle, "offset", min(k)::int as seq from r where k = 3 or "offset" % (k + 1) = 0 group by 1, 2, 3',
    "report_totals": f"""with {HITS_SQL}, r as (select *, unnest([1, 2, 3]) as run from hits), c as (select *, {CLASS_SQL} as k from r where run = 3 or "offset" % (run + 1) = 0),
      u as (select target, needle, "offset", count(*) as n, any_value(k) as k from c group by 1, 2, 3)
      select sum(n)::bigint as total, count(*) as unique_hits, sum(n - 1)::bigint as duplicates,
        count(distinct target) as targets, count_if(k.encrypted)::bigint as encrypted from u""",
    "report_counts": f"with {HITS_SQL}, c as (select *, {CLASS_SQL} as k from hits) select k.type as type, count(*) as hits, count_if(k.encrypted)::bigint as encrypted from c group by 1",
    "report_spans": f'with {HITS_SQL} select target, min("offset") as first_offset, max("offset") as last_offset, count(*) as hits from hits group by 1',
    "report_order": f'with {HITS_SQL} select target, "offset", needle from hits order by target, "offset", needle limit 50',
    "playbook": f"""with {HITS_SQL}, c as (select {CLASS_SQL} as k from hits), o as (select [{", ".join(repr(t) for t in scalars.PLAYBOOK)}] as t)
      select list_position(any_value(t), k.type)::int as step, k.type as type, count(*) as hits from c, o group by k.type""",
    "fingerprints": f'with {_LINE} select target, needle, "offset", fingerprint from marked',
    "baseline_anti": f"""with {_LINE} select target, needle, "offset" from marked m where not exists (
      select 1 from marked r where substr(r.target, 5)::bigint % 3 = 0 and r.fingerprint = m.fingerprint)""",
    "carve_bytes": f"""with {_HEX.format(HITS_SQL)} select target, needle, "offset",
      lower(substr(raw, (2 * greatest("offset" - 64, 0) + 1)::int, (2 * ("offset" + match_length + 64 - greatest("offset" - 64, 0)))::int)) as carve_hex from hexed""",
    "entropy": f"""with {_STATS} select target, total::bigint as size, count(*) as distinct_bytes, round(max(printable) / max(total), 4) as printable_ratio,
      round(-sum(n / total * log2(n / total)), 2) as entropy_bits from counted join summed using (target) group by target, total""",
    "carve_class": f"""with {HITS_SQL},
      cut as (select h.target, needle, "offset", greatest("offset" - 4096, 0) as start, substr(hex(encode(body)), (2 * greatest("offset" - 4096, 0) + 1)::int,
          (2 * ("offset" + match_length + 4096 - greatest("offset" - 4096, 0)))::int) as w from hits h join evidence e on e.target = h.target),
      bytes as (select target, needle, "offset", unnest(regexp_extract_all(w, '..')) as b from cut),
      counted as (select target, needle, "offset", b, count(*) as n from bytes group by 1, 2, 3, 4),
      summed as (select target, needle, "offset", sum(n) as total, sum(case when b in ('09', '0A', '0D') or b between '20' and '7E' then n else 0 end) as printable from counted group by 1, 2, 3),
      stats as (select target, needle, "offset", max(printable) / max(total) as share, -sum(n / total * log2(n / total)) as bits from counted join summed using (target, needle, "offset") group by 1, 2, 3),
      magic as (select *, string_split(w, m) as p from cut, (values {", ".join(f"({i}, '{k}', '{m.upper()}')" for i, (k, m) in enumerate(scalars.MAGICS))}) v(nth, kind, m)),
      split as (select target, needle, "offset", start, nth, kind, m, p, unnest(range(1, len(p))) as i from magic where len(p) > 1),
      placed as (select *, list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(m) as hex_at from split),
      best as (select target, needle, "offset", kind, (start + hex_at // 2)::bigint as magic_offset from placed where hex_at % 2 = 0
        qualify row_number() over (partition by target, needle, "offset" order by abs(start + hex_at // 2 - "offset"), nth, hex_at) = 1)
      select target, needle, "offset", coalesce(kind, case when share >= 0.9 then 'text' when bits >= 7.0 then 'high-entropy' else 'unknown' end) as class, coalesce(magic_offset, -1)::bigint as magic_offset, round(bits, 2) as entropy_bits
      from stats left join best using (target, needle, "offset")""",
    "source_hashes": f"with {EVIDENCE_SQL} select target, octet_length(encode(body))::bigint as size, sha256(body) as sha256, md5(body) as md5 from evidence",
    "verify_log": f"""with {EVIDENCE_SQL}, n as (select target, doc_id from evidence)
      select target, case when doc_id % 11 = 0 then 'NOT LOGGED' when doc_id % 13 = 0 then 'NOT SCANNED' when doc_id % 7 = 0 then 'MISMATCH' else 'OK' end as verdict from n""",
    "sweep_stats": f"""with {HITS_SQL} select (select count(*) from evidence) as files, count(distinct target) as files_with_hits, count(*) as hits,
      (select sum(octet_length(encode(body))) from evidence)::bigint as bytes from hits""",
    "asof_owner": f"""with {HITS_SQL}, r as (
        select target, k as owner, k * 1000 as start from (select target, unnest(range(0, octet_length(encode(body)) // 1000 + 1)) as k from evidence) where k % 4 <> 1)
      select h.target, h."offset", h.needle, r.owner::bigint as owner from hits h asof left join r on h.target = r.target and h."offset" >= r.start""",
    "first_per_needle": f"""with {HITS_SQL} select needle, target, "offset" from hits qualify row_number() over (partition by needle order by substr(target, 5)::bigint, "offset") = 1""",
    "carve_numbers": f'with {HITS_SQL} select row_number() over (order by target, "offset", needle) as seq, target, needle, "offset" from hits',
}
