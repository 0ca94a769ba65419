"""Nearest neighbours by randomly rotated one-bit codes.

A vector, less the mean, is rotated by a random orthogonal matrix and keeps the signs of its coordinates, its length and
the cosine between it and its signs. The rotated query is cut to whole numbers of eight bits, so its inner product with the
signs is a sum of population counts of packed bits and bit planes. Scaled by length and cosine this estimates the
true inner product within a bound that holds with overwhelming probability. A vector whose least possible distance lies beyond the
tenth best exact distance so far is passed over; the others are measured exactly.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

K = 10
EVERY = 100
SEED = 20
#: Standard errors of the estimate that the bound allows.
ERRORS = 4.0
#: Bits of a query's coordinate.
QUERY_BITS = 8
#: Queries that are sent to all tasks at once, and rows that are compared with them at once: these bound memory.
QUERY_BLOCK = 2048
ROW_BLOCK, QUERY_PART = 1024, 256


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances in double precision, squares added from first to last component."""
    return np.sqrt(np.cumsum((rows - query) ** 2, axis=1)[:, -1])


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the vectors that take part: no nulls, all finite, not zero."""
    v = F.col("v")
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.exists(v, lambda x: x != 0)
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.empty((0, dim))


def _mean(vectors: DataFrame, dim: int) -> np.ndarray:
    """The mean of all vectors, from one sum per task."""

    def run(batches):
        total, n = np.zeros(dim), 0
        for b in batches:
            m = _matrix(b.column(0), dim)
            total, n = total + m.sum(axis=0), n + len(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total), pa.array(np.full(dim, n))], names=["k", "s", "n"])

    sums = vectors.select("v").mapInArrow(run, "k long, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("mean")).orderBy("k").collect()
    return np.array([r["mean"] for r in sums])


def index(vectors: DataFrame, mean: np.ndarray, turn: np.ndarray) -> DataFrame:
    """vec_id, v, packed sign bits, norm and cosine of every valid vector."""
    dim = len(mean)

    def run(batches):
        for b in batches:
            turned = (_matrix(b.column(1), dim) - mean) @ turn
            norm = np.sqrt((turned**2).sum(axis=1))
            cosine = np.abs(turned).sum(axis=1) / np.sqrt(dim) / np.where(norm > 0, norm, 1)
            bits = np.packbits(turned > 0, axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(norm), pa.array(np.where(norm > 0, cosine, 1.0))],
                names=["vec_id", "v", "bits", "norm", "cosine"],
            )

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, bits binary, norm double, cosine double")


class Planes:
    """Rotated queries as bit planes: coordinate i is low + step * n_i, but for a part whose sizes add up to `lost`."""

    def __init__(self, turned: np.ndarray):
        self.dim, self.length, self.total = turned.shape[1], np.sqrt((turned**2).sum(axis=1)), turned.sum(axis=1)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << QUERY_BITS) - 1), np.finfo(float).tiny)
        n = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.lost = np.abs(turned - self.low[:, None] - self.step[:, None] * n).sum(axis=1)
        self.bits = [_words(np.packbits(n >> j & 1, axis=1)) for j in range(QUERY_BITS)]

    def part(self, queries: slice) -> Planes:
        other = object.__new__(Planes)
        other.dim, other.bits = self.dim, [b[queries] for b in self.bits]
        other.length, other.total, other.low, other.step, other.lost = (x[queries] for x in (self.length, self.total, self.low, self.step, self.lost))
        return other


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of packed bytes as rows of 64-bit words."""
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def _estimate(bits: np.ndarray, norm: np.ndarray, cosine: np.ndarray, turned: np.ndarray | Planes) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances (row, query) and the bound of their errors."""
    q = turned if isinstance(turned, Planes) else Planes(turned)
    codes = _words(bits)
    n = np.zeros((len(codes), len(q.length)), np.int64)
    for j, plane in enumerate(q.bits):
        for w in range(codes.shape[1]):
            n += np.bitwise_count(codes[:, w, None] & plane[None, :, w]).astype(np.int64) << j
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    signs = 2 * (q.low * ones[:, None] + q.step * n) - q.total  # of coordinates: those of set bits twice, less all
    scale = norm / (cosine * np.sqrt(q.dim))
    spread = norm * np.sqrt(np.maximum(1 - cosine**2, 0)) / cosine / np.sqrt(max(q.dim - 1, 1))
    squared = (norm**2)[:, None] + (q.length**2)[None, :] - 2 * signs * scale[:, None]
    error = 2 * ERRORS * spread[:, None] * q.length[None, :] + 4 * scale[:, None] * q.lost[None, :]
    return squared, error + 1e-9 * (norm**2)[:, None] + 1e-9 * (q.length**2)[None, :]


def _scan(ids: np.ndarray, queries: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int):
    dim, planes = len(mean), Planes((queries - mean) @ turn)
    parts = [slice(at, at + QUERY_PART) for at in range(0, len(ids), QUERY_PART)]

    def run(batches):
        best_d = np.full((len(ids), k), np.inf)
        best_i = np.full((len(ids), k), np.iinfo(np.int64).max)

        def merge(q, rows, v):
            d = np.concatenate([best_d[q], distances(v, queries[q])])
            i = np.concatenate([best_i[q], rows])
            first = np.lexsort((i, d))[:k]
            best_d[q], best_i[q] = d[first], i[first]

        for whole in batches:
            for at in range(0, whole.num_rows, ROW_BLOCK):
                b = whole.slice(at, ROW_BLOCK)
                row, v = b.column(0).to_numpy(), _matrix(b.column(1), dim)
                bits = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(row), -1)
                near = min(k + 1, len(row))
                for part in parts:
                    squared, error = _estimate(bits, b.column(3).to_numpy(), b.column(4).to_numpy(), planes.part(part))
                    least = squared - error
                    least[row[:, None] == ids[None, part]] = np.inf
                    for q in np.flatnonzero(np.isinf(best_d[part, -1])):  # nothing to compare with yet: the nearest by estimate
                        leading = np.argpartition(squared[:, q], near - 1)[:near]
                        leading = leading[np.isfinite(least[leading, q])]
                        merge(part.start + q, row[leading], v[leading])
                        least[leading, q] = np.inf
                    open_ = least <= best_d[part, -1] ** 2
                    open_ &= np.isfinite(least)
                    for q in np.flatnonzero(open_.any(axis=0)):
                        rest = np.flatnonzero(open_[:, q])
                        merge(part.start + q, row[rest], v[rest])
        q, r = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_i[q, r]), pa.array(best_d[q, r])], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, every: int = EVERY, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest of each query, a vector whose vec_id is divisible by `every`: query_id, rank, vec_id, score.

    Candidates are all other valid vectors of the query's length; score is their exact Euclidean distance; ties go to the
    smaller vec_id; fewer candidates give fewer rows. Every row is indexed, nothing is trained but the mean of all rows of a
    length. Queries pass in blocks: one block at a time goes to all tasks, each of which returns its k best per query. A query
    id that repeats is asked once for each length, with its least vector; other repeated rows are candidates each. No queries
    or an empty table give an empty result. Other columns are ignored.
    """
    fine = stage(valid(vectors))
    found = []
    for (dim,) in fine.select(F.size("v")).distinct().orderBy(F.size("v")).collect():  # a row per length that there is
        found += _search(fine.where(F.size("v") == dim), dim, every, k, query_block)
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(fine: DataFrame, dim: int, every: int, k: int, query_block: int) -> list[DataFrame]:
    """query_id, vec_id, score: the k best per query and task, a table per block of queries, of vectors of one length."""
    asked = fine.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    found, last, mean, turn, rows = [], None, None, None, None
    while True:
        block = asked if last is None else asked.where(F.col("vec_id") > last)
        block = block.orderBy("vec_id").limit(query_block).collect()
        if not block:
            return found
        if rows is None:
            mean, turn = _mean(fine, dim), rotation(dim)
            rows = stage(index(fine, mean, turn))
        last = block[-1]["vec_id"]
        run = _scan(np.array([r["vec_id"] for r in block]), np.array([r["v"] for r in block]), mean, turn, k)
        found.append(stage(rows.mapInArrow(run, "query_id long, vec_id long, score double")))
        if len(block) < query_block:
            return found


ORACLE = f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_reduce(list_transform(range(1, len(e.embedding) + 1), lambda i:
        (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) * (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE))
      ), lambda a, b: a + b)) AS score
    FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % {EVERY} = 0))
WHERE rank <= {K}
"""
