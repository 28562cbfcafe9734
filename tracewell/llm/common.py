"""What the operators share: the shared work folder, written intermediate tables, and sieves for keys."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the cluster names it. Where it is unset a
    session on one machine, as in tests, sets a temporary folder; on a cluster that would be a folder of each machine's
    own, from which tables would be read with parts missing, so that it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def work_folder(spark: SparkSession) -> str:
    """A folder of this process under the shared one; it goes when the driver ends."""
    root = shared_dir(spark)
    if root not in _scratch:
        _scratch[root] = f"{root.rstrip('/')}/tracewell-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _scratch[root])
    return _scratch[root]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors and isn't computed twice."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    _tables.append(path)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_tables: list[str] = []


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make returns as a table, after which the tables that were written for it go."""
    mark = len(_tables)
    out = written(make(), name)
    for path in _tables[mark:-1]:
        _remove(spark, path)
    del _tables[mark:-1]
    return out


CELLS, PAGE = 1 << 22, 1 << 15  # bits of a sieve, and of one of its pages, as bitmap_construct_agg makes them


class Sieve:
    """A bit table of fixed size over hashes of long keys, which drops most rows that a join would drop anyway before
    their texts are shuffled. It has no false negatives, and the join after it stays, so that it never decides a
    result; beyond some millions of keys it merely lets more through. Its pages, 128 of 4 KB at most, are what is
    broadcast; it is made and asked by Spark's expressions alone."""

    def __init__(self, keys: DataFrame, key: str):
        cell = self._cell(key)
        bits = keys.where(F.col(key).isNotNull()).select(F.floor(cell / PAGE).cast("int").alias("sieve_page"), (cell % PAGE).alias("bit"))
        self.pages = written(bits.groupBy("sieve_page").agg(F.bitmap_construct_agg("bit").alias("sieve_bits")), "sieve")

    @staticmethod
    def _cell(key: str) -> F.Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(CELLS))

    def marked(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """rows with a boolean column: may the key be among the sieve's? Never null."""
        own = rows.join(F.broadcast(self.pages), F.floor(self._cell(key) / PAGE).cast("int") == F.col("sieve_page"), "left")
        bit = (self._cell(key) % PAGE).cast("int")
        octet = F.conv(F.hex(F.substr("sieve_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = octet.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), bit % 8 + 1)) != 0
        return own.withColumn(name, F.col(key).isNotNull() & F.coalesce(hit, F.lit(False))).drop("sieve_page", "sieve_bits")

    def passing(self, rows: DataFrame, key: str) -> DataFrame:
        """Those rows whose key may be among the sieve's."""
        return self.marked(rows, key, "sieve_hit").where("sieve_hit").drop("sieve_hit")


def short_batches(spark: SparkSession) -> None:
    """Documents can be long: where the session leaves Spark's 10,000 rows an Arrow batch, take 1,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
