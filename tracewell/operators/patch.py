"""Patch series: each hit gets the commit, path and line of the patch line that holds it, by windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import history_fingerprint


def lines(sources: DataFrame) -> DataFrame:
    """(target, n, start, end, text) of every line of raw; end is past its line feed. Empty lines are left out, as they
    change no state; their bytes count."""
    parts = sources.select("target", F.posexplode(F.split("raw", "\n")).alias("n", "text"))
    w = Window.partitionBy("target").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    size = (F.length("text") + 1).cast("bigint")
    out = parts.withColumn("end", F.sum(size).over(w)).withColumn("start", F.col("end") - size)
    return out.where("text <> ''")


def unquoted(path: Column) -> Column:
    """A path as it is, or out of its C-style quotes: octal numbers are bytes, in the one-character-a-byte view."""
    inner = F.regexp_extract(path, r'^"(.*)"$', 1)
    letters = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
    named = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])

    def meant(t: Column) -> Column:
        rest = F.substr(t, F.lit(2))
        octal = F.char(F.conv(rest, 8, 10).cast("bigint"))
        return F.when(~t.startswith("\\"), t).when(t.rlike(r"^\\[0-7]{3}$"), octal).otherwise(F.coalesce(F.try_element_at(named, rest), rest))

    spelt = F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(r"(\\[0-7]{3}|\\.|[^\\])"), F.lit(1)), meant), "")
    return F.when(path.startswith('"') & path.endswith('"') & (F.length(path) > 1), spelt).otherwise(path)


def _side(text: Column) -> Column:
    """The path that a header line names, without blanks around it, quotes and the side's prefix; else empty. Only lines
    that begin as headers do are looked into."""
    header = text.startswith("diff --git ") | text.startswith("+++ ") | text.startswith("--- ")
    found = F.when(text.startswith("diff"), F.regexp_extract(text, r'^diff --git (?:"(?:[^"\\]|\\.)*"|.*?) ("?b/.*)$', 1)).otherwise(F.substr(text, F.lit(5)))
    prefix = F.when(text.startswith("-"), "a/").otherwise("b/")
    own = unquoted(F.regexp_replace(found, r"^\s+|\s+$", ""))
    return F.when(header, F.when(own.startswith(prefix), F.substr(own, F.lit(3))).otherwise(own)).otherwise("")


def state(rows: DataFrame) -> DataFrame:
    """Adds content, commit, path and line to lines: an island starts at each line that can't be a hunk's content; it is
    a hunk if that line is a closed hunk header; new-file lines count up within it."""
    w = Window.partitionBy("target").orderBy("n")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    shaped = F.left("text", F.lit(1)).isin("+", "-", " ", "\\")
    header = F.regexp_extract("text", r"^@@+ .*\+([0-9]+)(?:,[0-9]+)? @@", 1)
    out = rows.withColumn("shaped", shaped).withColumn("side", _side(F.col("text")))
    # "+++" and "---" before a hunk are headers: they have content's shape but stand in an island without a hunk
    out = out.withColumn("island", F.sum((~F.col("shaped")).cast("int")).over(so_far))
    own = Window.partitionBy("target", "island").orderBy("n")
    out = out.withColumn("hunk", F.first(F.when(header != "", header).cast("bigint")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("content", F.col("shaped") & F.col("hunk").isNotNull())
    commit = F.regexp_extract("text", r"^(?:commit|From) ([0-9a-f]{4,64})\b", 1)
    out = out.withColumn("own_commit", F.when(~F.col("content") & (commit != ""), commit))
    out = out.withColumn("series", F.count("own_commit").over(so_far)).withColumn("commit", F.last("own_commit", True).over(so_far))
    named, plus, minus = (F.when(F.col("text").startswith(x), F.col("side")).otherwise("") for x in ("diff --git ", "+++ ", "--- "))
    combined = F.regexp_extract("text", r"^diff --(?:cc|combined) (.*)$", 1)
    outside = ~F.col("content")
    in_series = Window.partitionBy("target", "series").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("old", F.last(F.when(outside & (minus != ""), minus), True).over(in_series))
    new_path = F.when(outside & (named != ""), named).when(outside & (combined != ""), combined).when(outside & (plus != ""), F.when(plus == "/dev/null", F.col("old")).otherwise(plus))
    out = out.withColumn("path", F.last(F.when(new_path != "/dev/null", new_path), True).over(in_series))
    grows = F.left("text", F.lit(1)).isin("+", " ").cast("int")
    before = F.coalesce(F.sum(grows).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line = F.when(F.col("content") & (grows == 1), F.col("hunk") + before).otherwise(F.lit(0))
    path = F.encode(F.coalesce("path", F.lit("")), "ISO-8859-1").cast("string")  # its bytes are UTF-8
    return out.select("target", "start", "end", "text", "commit", path.alias("path"), line.cast("bigint").alias("line"))


def attribute(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """hits with commit, path, line and history fingerprint: a sorted pass per target, no range join."""
    marked = state(lines(sources))
    kinds = [F.col(c) for c in ("text", "commit", "path", "line", "end")]
    left = hits.select("target", F.col("offset").alias("at"), F.lit(1).alias("side"), "needle", F.lit(None).cast("struct<text:string,commit:string,path:string,line:bigint,end:bigint>").alias("of"))
    right = marked.select("target", F.col("start").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("needle"), F.struct(*kinds).alias("of"))
    w = Window.partitionBy("target").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("of", F.last("of", True).over(w)).where("side = 1")
    inside = F.col("at") < F.col("of.end")
    out = out.select("target", F.col("at").alias("offset"), "needle", F.when(inside, F.col("of")).alias("of")).select("target", "offset", "needle", "of.*")
    mark = history_fingerprint(F.col("commit"), F.col("path"), F.col("needle"), F.encode("text", "ISO-8859-1"))
    return out.select("target", "offset", "needle", "commit", "path", "line", F.when(F.col("commit").isNotNull(), mark).alias("fingerprint"))
