"""Key text in raw bytes, and watch-only address rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from .shapes import matches

_RUN = "[1-9A-HJ-NP-Za-km-z]"
PRIVATE_KEY, EXTENDED_KEY = f"(?=([5KL9c]{_RUN}{{50,51}}))", f"(?=([xyztuv]p(?:rv|ub){_RUN}{{107}}))"


def key_hits(sources: DataFrame) -> DataFrame:
    """target, needle, offset, match_length of checksummed keys at any position: a native pattern first, the checksum
    only for what it leaves. A 52-character candidate is tried with 52 and with 51 characters."""

    @F.pandas_udf("struct<needle:string,size:int>")
    def label(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            found = next(((kind, n) for n in dict.fromkeys((len(text), min(len(text), 51) if len(text) < 60 else len(text))) if (kind := keys.key_label(text[:n]))), (None, None))
            out.append(found)
        return pd.DataFrame(out, columns=["needle", "size"]).astype({"size": "Int32"})

    def candidates(pattern: str) -> DataFrame:
        return sources.select("target", F.explode(matches(F.col("raw"), pattern, 1)).alias("m"))

    rows = candidates(PRIVATE_KEY).unionAll(candidates(EXTENDED_KEY)).withColumn("key", label("m.text"))
    return rows.where("key.needle is not null").select("target", "key.needle", F.col("m.offset").alias("offset"), F.col("key.size").alias("match_length"))


WATCH = "fingerprint string, version string, chain int, index int, path string, address string, script string"


def watch_addresses(accounts: DataFrame, per_chain: int = 20, most: int = 10_000, step: int = 50) -> DataFrame:
    """Public addresses of each extended public key (column key) on chains 0 and 1; private keys are refused.

    The grid of key, chain and runs of `step` indices is exploded and dealt out first, so that one key's addresses are
    derived by many tasks.
    """
    if not 1 <= per_chain <= most:
        raise ValueError(f"count {per_chain} is out of range 1-{most}")
    grid = accounts.select("key", F.explode(F.array(F.lit(0), F.lit(1))).alias("chain")).select("key", "chain", F.explode(F.sequence(F.lit(0), F.lit(per_chain - 1), F.lit(step))).alias("first"))

    def derive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for k, c, a in frame.itertuples(index=False) for r in keys.addresses(k, c, a, min(step, per_chain - a))]
            yield pd.DataFrame(rows, columns=["fingerprint", "version", "chain", "index", "path", "address", "script"])

    return grid.repartition("key", "chain", "first").mapInPandas(derive, WATCH)


def with_balances(addresses: DataFrame, balances: DataFrame) -> DataFrame:
    """Adds balance_sats from a table that the caller brings; nothing is looked up over a network."""
    return addresses.join(balances.select("address", "balance_sats"), "address", "left")
