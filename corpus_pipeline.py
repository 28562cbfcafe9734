"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of `documents`; extra columns are dropped.

In all stages a null text is empty, has no words and no secrets and isn't toxic; a null doc_id takes no part in comparisons,
so that its row stays as it is; rows that repeat a doc_id are kept or dropped together by near-duplicates and scored, cut and
packed each for itself; of equal documents the least doc_id stays. An empty table gives empty ones all the way.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import neardup, packing, secrets, substrings, toxicity, vocabulary
from tracewell.llm.common import Sieve, documents, settled, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(df: DataFrame, text: F.Column) -> DataFrame:
    """df with its text replaced and n_chars following where the text has changed."""
    changed = F.when(text == F.col("text"), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return df.select("doc_id", text.alias("text"), "lang", "source", changed.alias("n_chars"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, fitted on the labels' training fold, marks toxic go; all others stay."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays."""
    docs = docs.select(*COLUMNS)
    gone = written(neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "near-duplicates")
    maybe = Sieve(gone, "doc_id").marked(docs, "doc_id", "maybe")
    return maybe.where("not maybe").select(*COLUMNS).unionAll(maybe.where("maybe").join(gone, "doc_id", "left_anti").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 50 and more that an earlier document has too are cut out; every document stays."""
    kept = substrings.remove_repeats(docs.select(*COLUMNS), COLUMNS, ["text_kept", "n_removed"])
    chars = F.when(F.col("n_removed") > 0, F.length("text_kept").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.col("text_kept").alias("text"), "lang", "source", chars.alias("n_chars"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    found = secrets.scan(docs.select(*COLUMNS), COLUMNS)
    return _with_text(found, secrets.redacted(F.col("text"), F.col("spans")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary.default_path())


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("secret_scans", secret_spans),
    ("packing", packed),
]
ORACLE_SQL = None  # no stage's kernel machine, tokenizer or test battery has an SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settled(spark, partial(stage, spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
