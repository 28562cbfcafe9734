"""Queries over word evidence, shapes, intervals, patches and pages; each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..model import ScanOptions
from ..operators import intervals, literals, patch, scan, shapes, words
from ..sources import files
from .evidence import DESCRIPTOR_SQL_CHARACTERS, EVIDENCE_SQL, NEEDLES, RULE_WORDS, RULE_WORDS_SQL, VERSIONED_WINDOWS, evidence, viewed
from .hits import HITS_SQL


def word_list(spark: SparkSession, n: int = 2048) -> DataFrame:
    return spark.createDataFrame(list(zip(RULE_WORDS[:n], range(n))), "word string, ix int")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.tokens(viewed(spark, sf_dir))


def _listed(spark: SparkSession, sf_dir: str, n: int = 2048) -> DataFrame:
    return words.listed(_tokens(spark, sf_dir), word_list(spark, n))


def _seeds(own: DataFrame, lengths: tuple[int, ...] = words.SEED_LENGTHS) -> DataFrame:
    out = words.seeds(own, lengths[0])
    for n in lengths[1:]:
        out = out.unionAll(words.seeds(own, n))
    return out


def _shares(own: DataFrame) -> DataFrame:
    out = words.shares(own, words.SHARE_LENGTHS[0])
    for n in words.SHARE_LENGTHS[1:]:
        out = out.unionAll(words.shares(own, n))
    return out


def _hit(rows: DataFrame) -> DataFrame:
    """The public columns of word evidence: no words without reveal."""
    return rows.select("target", "needle", "start", "end")


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir).select("target", "pos", "start", "end", "ix")


def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.run_spans(_listed(spark, sf_dir)).select("target", "start", "end", "words")


def seed_exact_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit(words.seeds(_listed(spark, sf_dir), 12))


def seed_exact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _listed(spark, sf_dir)
    return _hit(_seeds(own))


def unordered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that hold no seed or share of any kind and length."""
    own = _listed(spark, sf_dir)
    return _hit(words.unordered_runs(own, _seeds(own).unionAll(words.versioned_seeds(own)).unionAll(_shares(_listed(spark, sf_dir, 1024)))))


def suppress_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12-word windows of listed words that lie outside every exact seed."""
    own = _listed(spark, sf_dir)
    return words.without_contained(words.windows(own, 12).select("target", "start", "end"), words.seeds(own, 12))


def slip39_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit(_shares(_listed(spark, sf_dir, 1024)))


def electrum_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _listed(spark, sf_dir)
    return _hit(words.without_contained(words.versioned_seeds(own), _seeds(own, words.SEED_LENGTHS[1:]), strictly=True))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_all(evidence(spark, sf_dir), NEEDLES, RULE_WORDS, ScanOptions(profile="secrets"))


def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections of all detectors, from one pass over the sources."""
    return _scanned(spark, sf_dir).select("target", "needle", "offset", "match_length", "block_offset", "verified", "fingerprint")


def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all seed lengths with one or two unlisted words, away from stronger evidence."""
    rows = _scanned(spark, sf_dir).where(F.col("needle").endswith("-near-miss"))
    return rows.select("target", "needle", F.col("offset").alias("start"), (F.col("offset") + F.col("match_length")).alias("end"), "gaps", "typos", "validating")


def typo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.typos(_tokens(spark, sf_dir), word_list(spark))


def _public(rows: DataFrame) -> DataFrame:
    return rows.select("target", "needle", "offset", "match_length")


def electrum_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(shapes.electrum_files(viewed(spark, sf_dir)))


def vault_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(shapes.vaults(viewed(spark, sf_dir)))


def secret_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.secrets(viewed(spark, sf_dir), "secrets").withColumn("verified", F.coalesce("verified", F.lit(False)))


def mkey_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.key_records(viewed(spark, sf_dir))


def keystore_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.keystore_parameters(shapes.keystores(viewed(spark, sf_dir)))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.descriptors(viewed(spark, sf_dir))


def union_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by needle of all detectors together; near misses are a query of their own."""
    rows = _scanned(spark, sf_dir).where(~F.col("needle").endswith("-near-miss"))
    return rows.groupBy("needle").agg(F.count("*").alias("hits"), F.countDistinct("target").alias("targets"), F.sum("offset").alias("offsets"), F.sum("match_length").alias("lengths"))


def token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = viewed(spark, sf_dir).select("target", F.explode(scalars.token_words(F.col("raw"))).alias("token"))
    return rows.groupBy("target").agg(F.count("*").alias("tokens"), F.countDistinct("token").alias("distinct_tokens"), F.min("token").alias("least"), F.max("token").alias("greatest"))


def token_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 256 most widespread tokens (ties: in byte order) with their variants."""
    rows = viewed(spark, sf_dir).select("target", F.explode(F.array_distinct(scalars.token_words(F.col("raw")))).alias("token"))
    top = rows.groupBy("token").agg(F.count("*").alias("targets")).orderBy(F.desc("targets"), "token").limit(256)
    return top.select("token", "targets", F.array_join(scalars.token_variants(F.col("token")), " ").alias("variants"))


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as spans of 900 s, merged."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    spans = e.select(F.col("user_id").alias("target"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("start"), F.lit(900).cast("bigint").alias("len"))
    return intervals.merge(spans)


def free_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive part keys that no line item of a supplier uses: a supplier's keys are its bitmap."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return intervals.free_runs(li, "l_suppkey", "l_partkey").select("l_suppkey", "first", "units")


def page_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line item of each (order, part): one page a number, by offset."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber")
    return intervals.first_of(li, ["l_orderkey", "l_partkey"], [F.col("l_linenumber")])


def plurality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most frequent event type; the one seen first wins ties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id")
    return intervals.plurality(e, ["user_id"], "event_type", "event_id")


def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.orderBy("o_totalprice", "o_custkey", "o_orderkey").limit(128)


def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as numbered segments of one image, of which number 41 is missing: what follows isn't part of it."""
    from pyspark.sql.window import Window

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    named = d.withColumn("n", n + (n > 40).cast("int")).withColumn("target", F.format_string("%s.%03d", "source", "n"))
    return files.segment_order(named).select("image", "n", "target", "start", "size")


# A patch series a document: a message that names a needle, then hunks whose lines carry the document's number.
_PATCH = [
    "commit {h}", "Author: someone", "", "    mention wallet.dat here", "", "diff --git a/src/f{d}.txt b/src/f{d}.txt", "--- a/src/f{d}.txt", "+++ b/src/f{d}.txt",
    "@@ -1,3 +{n},4 @@ ctx", " keep {d}", "-old hdseed {d}", "+new crypted_key {d}", "+++ wallet.dat {d}", " end", "@@ -40,1 +{m},2 @@", "+late keymeta {d}",
    "diff --git a/gone b/gone", "--- a/gone", "+++ /dev/null", "@@ -1,1 +0,0 @@", "-bestblock {d}",
]


def _patch_column() -> F.Column:
    d = F.col("doc_id").cast("string")
    parts = {"{d}": d, "{h}": F.md5(d), "{n}": (F.col("doc_id") % 50 + 1).cast("string"), "{m}": (F.col("doc_id") % 50 + 60).cast("string")}
    text: F.Column = F.lit("\n".join(_PATCH) + "\n")
    for k, v in parts.items():
        text = F.replace(text, F.lit(k), v)
    return text


def patch_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("patch-"), F.col("doc_id").cast("string")).alias("target"), _patch_column().alias("raw"))
    return patch.attribute(literals.literal_hits(d, NEEDLES).select("target", "needle", "offset"), d)


_PATCH_SQL = """with d as (
  select doc_id, 'patch-' || doc_id as target, md5(doc_id::varchar) as h, doc_id::varchar as d, doc_id % 50 + 1 as n, doc_id % 50 + 60 as m from documents),
lines as (
  select target, h, d, n, m, unnest(range(1, {count} + 1)) as i, unnest([{lines}]) as text from d),
filled as (
  select target, i, h, n, m, replace(replace(replace(replace(text, '{{d}}', d), '{{h}}', h), '{{n}}', n::varchar), '{{m}}', m::varchar) as text from lines),
placed as (
  select *, coalesce(sum(length(text) + 1) over (partition by target order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from filled),
found as (
  select *, unnest([{needles}]) as needle from placed)
select target, start + strpos(text, needle) - 1 as "offset", needle, h as commit,
  case when i < 6 then '' when i < 17 then 'src/f' || substr(target, 7) || '.txt' else 'gone' end as path,
  (case i when 12 then n + 1 when 13 then n + 2 when 16 then m else 0 end)::bigint as line,
  'v1/history/' || h || '/' || case when i < 6 then '' when i < 17 then 'src/f' || substr(target, 7) || '.txt' else 'gone' end || '/' || needle || '/' || left(sha256(text), 16) as fingerprint
from found where contains(text, needle)""".format(count=len(_PATCH), lines=", ".join(f"'{x}'" for x in _PATCH), needles=", ".join(f"'{n}'" for n in NEEDLES))

QUERIES = {
    f.__name__: f
    for f in (
        word_tokens, word_runs, seed_exact_12, seed_exact_all, unordered_runs, suppress_contained, slip39_shares, electrum_seeds, near_misses, typo_distance, scan_all, electrum_files,
        vault_shapes, secret_shapes, mkey_records, keystore_params, descriptors, union_detectors, token_words, token_variants, interval_merge, free_runs, page_dedupe,
        plurality_vote, topk_candidates, split_segments, patch_attribution,
    )
}

TOKENS_SQL = f"""{EVIDENCE_SQL},
pieces as (
  select target, unnest(range(1, len(p) + 1)) as i, unnest(p) as piece from (select target, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]+') as p from evidence)),
placed as (
  select target, lower(piece) as word, regexp_matches(piece, '^[A-Za-z]') as letters, octet_length(encode(piece)) as size,
    sum(octet_length(encode(piece))) over (partition by target order by i)::bigint as "end", i from pieces),
tokens as (
  select target, word, "end" - size as start, "end", row_number() over (partition by target order by i) - 1 as pos from placed where letters),
listed as (select target, pos, start, "end", l.word, ix from tokens join {RULE_WORDS_SQL} l using (word)),
runs as (select *, pos - row_number() over (partition by target order by pos) as run from listed)"""


def _windows_sql(n: int, extra: str = "") -> str:
    return f"""w{n} as (
  select target, start, max("end") over w as "end", list(ix) over w as ixs from runs{extra}
  window w as (partition by target, run order by pos rows between current row and {n - 1} following)),
full{n} as (select * from w{n} where len(ixs) = {n}),
bits{n} as (
  select *, array_to_string(list_transform(ixs, lambda x: lpad(bin(x), 11, '0')), '') as bits from full{n}),
seeds{n} as (
  select target, 'bip39-{n}' as needle, start, "end" from bits{n} where "end" - start <= 511
    and lpad(bin(('0x' || left(sha256(from_hex(array_to_string(list_transform(range(0, {(n * 11 - n // 3) // 4}),
      lambda k: hex(list_reduce([0, substr(bits, (4 * k + 1)::int, 1)::int, substr(bits, (4 * k + 2)::int, 1)::int, substr(bits, (4 * k + 3)::int, 1)::int, substr(bits, (4 * k + 4)::int, 1)::int],
        lambda a, b: a * 2 + b))), ''))), 2))::int), 8, '0')[1:{n // 3}] = substr(bits, {n * 11 - n // 3 + 1}))"""


_SEEDS_SQL = f"with {TOKENS_SQL}, {_windows_sql(12)}"


def _polymod_sql(prefix: str) -> str:
    mixed = "0::bigint"
    for i, g in enumerate(words.SHARE_GENERATORS):
        mixed = f"xor({mixed}, (case when (a >> {20 + i}) & 1 = 1 then {g} else 0 end)::bigint)"
    return f"list_reduce(list_concat([1::bigint], list_concat([{', '.join(f'{ord(c)}::bigint' for c in prefix)}], list_transform(ixs, lambda x: x::bigint))), lambda a, b: xor(xor((a & 1048575) << 10, b), {mixed}))"


_SHARES_SQL = f"""with {TOKENS_SQL.replace("from range(2048)", "from range(1024)")}, {", ".join(_windows_sql(n).split("," + chr(10) + f"bits{n}")[0] for n in words.SHARE_LENGTHS)},
      shared as ({" union all ".join(f"select *, 'slip39-{n}' as needle from full{n}" for n in words.SHARE_LENGTHS)})
      select target, needle, start, "end" from shared
      where ((ixs[3] >> 2) & 15) <= (((ixs[3] & 3) << 2) | (ixs[4] >> 8)) and (case when (ixs[2] >> 4) & 1 = 1 then {_polymod_sql("shamir_extendable")} else {_polymod_sql("shamir")} end) = 1"""
_ALL_SEEDS_SQL = " union all ".join(f'select target, needle, start, "end" from seeds{n}' for n in words.SEED_LENGTHS)
#: SQL has no HMAC-SHA512: which windows of the planted phrases have a version prefix is worked out beforehand.
_ELECTRUM_CTE = f"""versioned as (select target, 'electrum-seed' as needle, start, "end" from full12 where array_to_string(ixs, ' ') in ({", ".join(f"'{w}'" for w in VERSIONED_WINDOWS)}))"""
QUOTE = '"'


def _vault_sql(name: str, quote: str) -> str:
    """The first vault of each body whose keys stand between such quotes (evidence plants one)."""
    value = lambda key: f"""regexp_extract(substr(body, strpos(body, '{quote}{key}{quote}')), '^{quote.replace(chr(92), chr(92) * 2)}{key}{quote.replace(chr(92), chr(92) * 2)}\\s*:\\s*{quote.replace(chr(92), chr(92) * 2)}([^"\\\\]*){quote.replace(chr(92), chr(92) * 2)}', 1)"""
    return f"""{name}_values as (select target, body, {value("data")} as d, {value("iv")} as i, {value("salt")} as s, strpos(body, '{quote}iv{quote}') as p from evidence where strpos(body, '{quote}iv{quote}') > 0),
      {name}_spans as (select *, list_min([p, strpos(body, d), strpos(body, s)]) as a, list_max([strpos(body, d) + length(d), strpos(body, i) + length(i), strpos(body, s) + length(s)]) as b from {name}_values
        where d <> '' and i <> '' and s <> '' and length(d) % 4 = 0 and length(i) % 4 = 0 and length(s) % 4 = 0),
      {name} as (select target, 'metamask-vault' as needle, octet_length(encode(left(body, (a - 1)::int)))::bigint as "offset", (b - a)::int as match_length from {name}_spans
        where octet_length(from_base64(d)) >= 16 and octet_length(from_base64(i)) = 16 and octet_length(from_base64(s)) = 32)"""


def _at(pattern_hit: str) -> str:
    return f"octet_length(encode(left(body, (strpos(body, {pattern_hit}) - 1)::int)))::bigint"


def _descriptor_sql() -> str:
    mixed = "0::bigint"
    for i, g in enumerate(shapes.DESCRIPTOR_GENERATORS):
        mixed = f"xor({mixed}, (case when (a >> {35 + i}) & 1 = 1 then {g} else 0 end)::bigint)"
    step = f"xor(xor((a & {0x7FFFFFFFF}) << 5, b), {mixed})"
    return f"""with {EVIDENCE_SQL}, m as (select target, body, regexp_extract(body, 'pkh\\([0-9a-f]{{66}}\\)#[a-z0-9]{{8}}') as x from evidence),
      p as (select *, list_transform(string_split(split_part(x, '#', 1), ''), lambda c: strpos({DESCRIPTOR_SQL_CHARACTERS}, c)::bigint - 1) as pos from m where x <> ''),
      v as (select *, flatten(list_transform(range(0, ((len(pos) + 2) // 3)::int), lambda k: list_append(list_transform(pos[3 * k + 1:3 * k + 3], lambda y: y & 31),
        list_reduce(list_prepend(0::bigint, list_transform(pos[3 * k + 1:3 * k + 3], lambda y: y >> 5)), lambda a, b: a * 3 + b)))) as v from p),
      c as (select *, xor(list_reduce(list_concat([1::bigint], list_concat(v, list_transform(range(8), lambda k: 0::bigint))), lambda a, b: {step}), 1) as c from v)
      select target, 'descriptor' as needle, {_at("x")} as "offset", length(x)::int as match_length from c
      where array_to_string(list_transform(range(8), lambda n: substr('{shapes.DESCRIPTOR_OUTPUT}', ((c >> (5 * (7 - n))::int) & 31)::int + 1, 1)), '') = split_part(x, '#', 2)"""


_DESCRIPTORS_SQL = _descriptor_sql()

ORACLE = {
    "word_tokens": f'with {TOKENS_SQL} select target, pos, start, "end", ix from listed',
    "word_runs": f'with {TOKENS_SQL} select target, min(start) as start, max("end") as "end", count(*) as words from runs group by target, run having count(*) >= 12',
    "seed_exact_12": f'{_SEEDS_SQL} select target, needle, start, "end" from seeds12',
    "seed_exact_all": f"with {TOKENS_SQL}, {', '.join(_windows_sql(n) for n in words.SEED_LENGTHS)} " + " union all ".join(f'select target, needle, start, "end" from seeds{n}' for n in words.SEED_LENGTHS),
    "unordered_runs": f"""with {TOKENS_SQL}, {', '.join(_windows_sql(n) for n in words.SEED_LENGTHS)}, shares as ({_SHARES_SQL}), {_ELECTRUM_CTE},
      strong as ({_ALL_SEEDS_SQL} union all select target, needle, start, "end" from versioned union all select target, needle, start, "end" from shares),
      r as (select target, min(start) as start, max("end") as "end" from runs group by target, run having count(*) >= 12)
      select target, 'bip39-unordered' as needle, start, "end" from r where not exists (select 1 from strong s where s.target = r.target and s.start >= r.start and s."end" <= r."end")""",
    "suppress_contained": f"""{_SEEDS_SQL} select target, start, "end" from full12 w where not exists (
      select 1 from seeds12 s where s.target = w.target and w.start >= s.start and w."end" <= s."end")""",
    "slip39_shares": _SHARES_SQL,
    "electrum_seeds": f"""with {TOKENS_SQL}, {', '.join(_windows_sql(n) for n in words.SEED_LENGTHS)}, {_ELECTRUM_CTE}, longer as (select * from ({_ALL_SEEDS_SQL}) where needle <> 'bip39-12')
      select target, needle, start, "end" from versioned v where not exists (select 1 from longer s where s.target = v.target and v.start >= s.start and v."end" <= s."end")""",
    "electrum_files": f"""with {EVIDENCE_SQL}, m as (select target, body, regexp_extract(body, '"seed_version"\\s*:\\s*[0-9]+') as s, regexp_extract(body, '"wallet_type"\\s*:\\s*"[^"\\\\]*"') as w from evidence),
        p as (select *, strpos(body, s) as ps, strpos(body, w) as pw from m where s <> '' and w <> ''),
        x as (select target, body, case when ps < pw then ps else pw end as a, case when ps < pw then pw + length(w) else ps + length(s) end as b,
          case when ps < pw then pw - ps - length(s) else ps - pw - length(w) end as gap from p)
      select target, 'electrum-file' as needle, octet_length(encode(left(body, (a - 1)::int)))::bigint as "offset", (b - a)::int as match_length from x where gap <= 2000""",
    "vault_shapes": f"with {EVIDENCE_SQL}, {_vault_sql('plain', QUOTE)}, {_vault_sql('escaped', chr(92) + QUOTE)} select * from plain union all select * from escaped",
    "secret_shapes": f"""with {EVIDENCE_SQL}, m as (
        select target, body, 'aws-access-key' as needle, regexp_extract(body, '\\bAKIA[A-Z0-9]{{16}}\\b') as x from evidence
        union all select target, body, 'github-token', regexp_extract(body, '\\bgh[pousr]_[A-Za-z0-9]{{36}}\\b') from evidence
        union all select target, body, 'pem-private-key', regexp_extract(body, '-----BEGIN (OPENSSH )?PRIVATE KEY-----\\s+[A-Za-z0-9+/=\\s]+?-----END (OPENSSH )?PRIVATE KEY-----') from evidence)
      select target, needle, {_at("x")} as "offset", length(x)::int as match_length, needle = 'pem-private-key' and not contains(x, 'OPENSSH') as verified from m where x <> ''""",
    "mkey_records": f"""with {EVIDENCE_SQL}, m as (select target, body, regexp_extract(body, '(?s)0[\\x00-\\x7f]{{48}}\\x08[\\x00-\\x7f]{{8}}\\x00{{4}}[\\x00-\\x7f]{{4}}') as x from evidence where contains(body, chr(8)))
      select target, {_at("x")} as "offset", (ascii(substr(x, 63, 1)) + 256 * ascii(substr(x, 64, 1)) + 65536 * ascii(substr(x, 65, 1)) + 16777216 * ascii(substr(x, 66, 1)))::bigint as iterations
      from m where x <> ''""",
    "keystore_params": f"""with {EVIDENCE_SQL}, m as (select target, body, regexp_extract(body, '\\{{"address":"[0-9a-f]{{40}}","crypto":.*"version":3\\}}') as x from evidence)
      select target, {_at("x")} as "offset", json_extract_string(x, '$.crypto.kdf') as kdf,
        case when json_extract_string(x, '$.crypto.kdfparams.n')::int > 0 then null else 'scrypt parameters' end as reason from m where x <> ''""",
    "descriptors": _DESCRIPTORS_SQL,
    "union_detectors": None,
    "token_words": f"""with {EVIDENCE_SQL}, t as (select target, unnest(regexp_extract_all(body, '[A-Za-z0-9]+')) as token from evidence)
      select target, count(*) as tokens, count(distinct token) as distinct_tokens, min(token) as least, max(token) as greatest from t where length(token) between 3 and 32 group by target""",
    "token_variants": f"""with {EVIDENCE_SQL}, t as (select distinct target, unnest(regexp_extract_all(body, '[A-Za-z0-9]+')) as token from evidence),
      top as (select token, count(*) as targets from t where length(token) between 3 and 32 group by token order by targets desc, token limit 256),
      v as (select token, targets, unnest([token, lower(token), upper(token), upper(left(token, 1)) || lower(substr(token, 2))]) as x, unnest([1, 2, 3, 4]) as n from top),
      u as (select token, targets, x, min(n) as n from v group by 1, 2, 3)
      select token, targets, string_agg(x, ' ' order by n) as variants from u group by 1, 2""",
    "interval_merge": """with s as (select user_id as target, (epoch_us(ts) // 1000000) as start, (epoch_us(ts) // 1000000) + 900 as "end" from events),
      o as (select *, coalesce(start > max("end") over (partition by target order by start, "end" rows between unbounded preceding and 1 preceding), true) as new from s),
      i as (select *, sum(new::int) over (partition by target order by start, "end" rows unbounded preceding) as island from o)
      select target, min(start) as start, max("end") - min(start) as len from i group by target, island""",
    "free_runs": """with k as (select distinct l_suppkey, l_partkey from lineitem), i as (select *, l_partkey - row_number() over (partition by l_suppkey order by l_partkey) as island from k)
      select l_suppkey, min(l_partkey) as first, count(*) as units from i group by l_suppkey, island""",
    "page_dedupe": "select l_orderkey, l_partkey, min(l_linenumber) as l_linenumber from lineitem group by 1, 2",
    "plurality_vote": """with n as (select user_id, event_type, count(*) as votes, min(event_id) as seen from events group by 1, 2)
      select user_id, event_type, votes from n qualify row_number() over (partition by user_id order by votes desc, seen, event_type) = 1""",
    "topk_candidates": "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice, o_custkey, o_orderkey limit 128",
    "split_segments": """with d as (select source as image, octet_length(encode(coalesce(text, '')))::bigint as size, row_number() over (partition by source order by doc_id) as n from documents)
      select image, n::int as n, image || '.' || lpad(n::varchar, greatest(3, length(n::varchar))::int, '0') as target,
        coalesce(sum(size) over (partition by image order by n rows between unbounded preceding and 1 preceding), 0)::bigint as start, size from d where n <= 40""",
    "patch_attribution": _PATCH_SQL,
}
_SPANS = ("seed_exact_all", "electrum_seeds", "slip39_shares", "unordered_runs")
_SHAPES = ("electrum_files", "vault_shapes", "secret_shapes", "descriptors")
ORACLE["union_detectors"] = f"""with {HITS_SQL}, own as (select target, needle, "offset", match_length from hits
        union all {" union all ".join(f'select target, needle, start, ("end" - start)::int from ({ORACLE[n]})' for n in _SPANS)}
        union all {" union all ".join(f'select target, needle, "offset", match_length from ({ORACLE[n]})' for n in _SHAPES)}
        union all select target, 'mkey', "offset", 66 from ({ORACLE["mkey_records"]})
        union all select target, 'eth-keystore', "offset", size from (with {EVIDENCE_SQL}, m as (select target, body, regexp_extract(body, '\\{{"address":"[0-9a-f]{{40}}","crypto":.*"version":3\\}}') as x from evidence)
          select target, {_at("x")} as "offset", length(x)::int as size from m where x <> ''))
      select needle, count(*) as hits, count(distinct target) as targets, sum("offset")::bigint as offsets, sum(match_length)::bigint as lengths from own group by needle"""
