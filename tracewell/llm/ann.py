"""Approximate nearest neighbours by inner product from randomly rotated one-bit codes.

A vector, less the mean of all vectors, is rotated at random and kept as one bit a dimension, with two scalars: its
length and the cosine between it and its code. From these an unbiased estimate of its inner product with a query
follows, with an error bound that falls with the dimension. Within a block of vectors the k-th best true inner product
among the vectors of highest estimate is a floor; all vectors whose upper bound reaches it are reranked by their
original numbers in double precision.

Queries and vectors are dealt out in blocks of bounded size and every block of queries meets every block of vectors in
one task; each gives its best k, and the best of these are kept. The index holds every row; only the mean is shared.
Vectors travel as they are stored (single precision stays so) and are widened where they are used. With blocks of b
vectors and c queries, n vectors and m queries, n * m / c + n * m / b rows are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SURE = 3.5  # standard deviations of the estimate within which the bounds lie


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed + dim)).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v) of rows with a key and a vector that isn't null, zero or empty and has only finite components."""
    kind = dict(vectors.dtypes)[column]
    c = F.col(column).cast(kind if kind == "array<float>" else "array<double>")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)) & F.exists(c, lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), c.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def means(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Number and mean of the vectors of each dimension, summed up in the scan."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for dim, _, v in _by_dim(batch.column("v")):
                old = sums.setdefault(dim, [0, np.zeros(dim)])
                old[0] += len(v)
                old[1] += v.sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].tolist() for s in sums.values()], pa.list_(pa.float64()))],
            ["dim", "n", "s"],
        )

    parts = rows.select("v").mapInArrow(add, "dim int, n long, s array<double>").select("dim", "n", F.posexplode("s").alias("at", "x"))
    found: dict[int, tuple[int, np.ndarray]] = {}
    for dim, n, xs in parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).groupBy("dim").agg(F.max("n"), F.sort_array(F.collect_list(F.struct("at", "x")))).collect():
        found[dim] = (n, np.array([x for _, x in xs]) / n)
    return found


def _by_dim(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, their vectors in double precision)."""
    size = np.diff(column.offsets.to_numpy())
    flat, start = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield dim, rows, flat[(start[rows][:, None] + np.arange(dim)).ravel()].reshape(-1, dim).astype(np.float64)


def index(rows: DataFrame, centre: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """(id, dim, code, length, cosine, v): packed bits, the two correction scalars and the original vector."""
    mean = {d: m for d, (_, m) in centre.items()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, v in _by_dim(batch.column("v")):
                turned = (v - mean[dim]) @ rotation(dim)
                length = np.sqrt((turned**2).sum(1))
                cosine = np.abs(turned).sum(1) / np.maximum(length, 1e-300) / math.sqrt(dim)
                codes = [x.tobytes() for x in np.packbits(turned > 0, axis=1)]
                own = batch.take(pa.array(at))
                kinds = [pa.array(np.full(len(at), dim, np.int32)), pa.array(codes, pa.binary()), pa.array(length), pa.array(cosine)]
                yield pa.RecordBatch.from_arrays([own.column("id"), *kinds, own.column("v")], ["id", "dim", "code", "length", "cosine", "v"])

    return rows.select("id", "v").mapInArrow(encode, f"id long, dim int, code binary, length double, cosine double, v {dict(rows.dtypes)['v']}")


def exact(q: np.ndarray, v: np.ndarray, row: np.ndarray, at: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Inner products q[:, row] . v[:, at] in double precision, summed in the order of the components; q and v hold a
    component a row, so that the gathers stay in the cache."""
    out = np.empty(len(row))
    for x in range(0, len(row), step):
        r, a = row[x : x + step], at[x : x + step]
        total = np.zeros(len(r))
        for k in range(len(q)):
            total += q[k].take(r) * v[k].take(a)
        out[x : x + step] = total
    return out


def _search(k: int, mean: dict[int, np.ndarray], sure: float, slab: int = 128):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = np.array(table.column("query").to_pylist(), bool)
        out: list[tuple[np.ndarray, ...]] = []
        if side.any() and not side.all():
            dim = table.column("dim")[0].as_py()
            vectors = next(_by_dim(table.column("v").chunk(0)))[2]
            ids = table.column("id").to_numpy()
            q, v, qi, vi = vectors[side], vectors[~side], ids[side], ids[~side]
            own = table.filter(pa.array(~side))
            codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(len(v), -1)
            signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
            length, cosine = (own.column(c).to_numpy().astype(np.float32) for c in ("length", "cosine"))
            gain = length / (np.maximum(cosine, 1e-6) * math.sqrt(dim))
            slack = length * np.sqrt(np.maximum(1 - cosine**2, 0)) / np.maximum(cosine, 1e-6) / math.sqrt(max(dim - 1, 1))
            qt, vt = np.ascontiguousarray(q.T), np.ascontiguousarray(v.T)
            turned = (q @ rotation(dim)).astype(np.float32)
            base, size = (q @ mean[dim]).astype(np.float32), np.sqrt((q**2).sum(1)).astype(np.float32)
            for a in range(0, len(q), slab):
                about = (turned[a : a + slab] @ signs.T) * gain + base[a : a + slab, None]
                error = sure * size[a : a + slab, None] * slack + 1e-5 * (np.abs(about) + 1)
                own = qi[a : a + slab, None] == vi
                about[own] = -np.inf
                few = min(len(v), 3 * k + 1)
                best = np.argpartition(about, len(v) - few, axis=1)[:, len(v) - few :]
                first = exact(qt, vt, np.repeat(np.arange(a, a + len(about)), few), best.ravel()).reshape(-1, few)
                first[np.take_along_axis(own, best, 1)] = -np.inf
                floor = np.partition(first, max(few - k, 0), axis=1)[:, max(few - k, 0)]
                row, at = np.nonzero((about + error >= floor[:, None]) & ~own)
                score = exact(qt, vt, a + row, at)
                good = score >= floor[row]
                row, at, score = row[good], at[good], score[good]
                order = np.lexsort((vi[at], -score, row))
                row, at, score = row[order], at[order], score[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                best = place < k
                out.append((qi[a + row[best]], vi[at[best]], score[best]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    return run


def search(vectors: DataFrame, queries: F.Column, k: int = 20, key: str = "vec_id", column: str = "embedding", sure: float = SURE, block: int = 16384, query_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of each row for which `queries` holds, among all other
    rows of the same dimension, by inner product; ties go to the smaller id.

    Vectors that are null, empty or zero, or hold nulls, infinities or NaN take no part, nor do rows with a null id.
    Rows that repeat an id are one another's own and aren't found for it; as neighbours each counts. Other columns are
    ignored. An empty table gives an empty result; a query without candidates has no row.
    """
    rows = usable(vectors, key, column)
    centre = means(rows)
    result = T.StructType.fromDDL("query_id long, vec_id long, score double")
    total = sum(n for n, _ in centre.values())
    wanted = usable(vectors.where(queries), key, column).count() if total else 0
    parts, q_parts = max(1, -(-total // block)), max(1, -(-wanted // query_block))
    built = index(rows, centre)
    cell = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    held = built.withColumn("part", cell(parts)).withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1)))).withColumn("query", F.lit(False))
    asked = index(usable(vectors.where(queries), key, column), centre).withColumn("q_part", cell(q_parts)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("query", F.lit(True))
    both = held.unionByName(asked)
    found = both.groupBy("dim", "part", "q_part").applyInArrow(_search(k, {d: m for d, (_, m) in centre.items()}, sure), result)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_rotated_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
with fine as (
  select vec_id, embedding::double[] as v from embeddings where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
    list_reduce(list_prepend(0::double, list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), lambda a, b: a + b) as score
  from fine q join fine c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 20"""

QUERIES = {"op3_rotated_bit_ann": op3_rotated_bit_ann}
ORACLE = {"op3_rotated_bit_ann": ORACLE_SQL}
