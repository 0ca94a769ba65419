"""Whitening of embeddings by an exact scatter of their bit planes.

Entries become integers. A batch of rows is laid out bit by bit: for each dimension and bit, one bit of every row, packed
into 64-bit words. The sum over rows of a product of two dimensions is then the sum over pairs of their bits of the weight times
the population count of the AND of two planes. All of it is integer arithmetic, so sums over tasks are exact in any order.
The scatter is centred as integers (n times the sum of products, less the product of sums) before eigh sees it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, stage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries whose integer is beyond this count as non-finite: sums of their products could not be exact in 38 digits.
LARGEST = 1 << 40
#: Rows whose bit planes are compared at once.
ROWS = 4096
#: Eigenvalues below this share of the greatest are taken for zero, and have no component.
LEAST = 1e-12


def integers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Key and x, the integers of each usable vector: not null and not empty, all entries finite and within LARGEST."""
    x = F.transform(F.col(column), lambda c: F.floor(SCALE * c.cast("double")) + SHIFT)
    fine = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST / SCALE))
    return vectors.where((F.size(column) > 0) & fine).select(F.col(key), x.alias("x"))


def cross_products(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Per-dimension sums and all sums of products of two dimensions, exactly, by bit planes."""
    rows, dims = x.shape
    low = x.min(axis=0)
    shifted = (x - low).astype(np.uint64)
    bits = [max(1, int(v).bit_length()) for v in shifted.max(axis=0)]
    padded = -rows % 64
    planes = []
    for d, n in enumerate(bits):
        column = np.concatenate([shifted[:, d], np.zeros(padded, np.uint64)])
        for b in range(n):
            planes.append(np.packbits(((column >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).view(np.uint64))
    planes = np.stack(planes)
    first = np.concatenate([[0], np.cumsum(bits)])
    both = np.stack([np.bitwise_count(planes & p).sum(axis=1, dtype=np.int64) for p in planes])
    # A weight is at most 2^41 * 2^41, so products are taken as Python integers where they could pass 63 bits.
    kind = np.int64 if 2 * max(bits) + int(rows).bit_length() < 62 else object
    weights = np.array([1 << b for n in bits for b in range(n)], dtype=kind)
    weighted = both.astype(kind) * weights[:, None] * weights[None, :]
    products = np.add.reduceat(np.add.reduceat(weighted, first[:-1], axis=0), first[:-1], axis=1)
    ones = np.add.reduceat(both.diagonal().astype(kind) * weights, first[:-1])
    s, l = [int(v) for v in ones], [int(v) for v in low]
    sums = [a + rows * b for a, b in zip(s, l)]
    crossed = [[int(products[i, j]) + l[j] * s[i] + l[i] * s[j] + rows * l[i] * l[j] for j in range(dims)] for i in range(dims)]
    return sums, crossed


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _scatter(batches):
    """Rows (dims, i, j, value): of each task, how many rows there are (i = j = -1), sums (j = -1) and sums of products, i <= j."""
    totals: dict[int, tuple] = {}
    for b in batches:
        dims_of = b.column(0).value_lengths().to_numpy()
        for dims in np.unique(dims_of).tolist():
            x = _matrix(b.column(0).filter(pa.array(dims_of == dims)))
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                sums, crossed = cross_products(part)
                if dims not in totals:
                    totals[dims] = [0, [0] * dims, [[0] * dims for _ in range(dims)]]
                t = totals[dims]
                t[0] += len(part)
                t[1] = [a + c for a, c in zip(t[1], sums)]
                t[2] = [[a + c for a, c in zip(r, q)] for r, q in zip(t[2], crossed)]
    for dims, (n, sums, crossed) in totals.items():
        found = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(sums)), *((i, j, crossed[i][j]) for i in range(dims) for j in range(i, dims))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([dims] * len(found), pa.int32()), *(pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)), pa.array([str(f[2]) for f in found])], names=["dims", "i", "j", "value"]
        )


def _components(n: int, sums: list[int], crossed: dict[tuple[int, int], int], most: int) -> dict:
    """Unit eigenvectors of the covariance, columns by falling eigenvalue; and the eigenvalues and their shares."""
    dims = len(sums)
    centred = [[n * crossed[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    v = np.array([[c / (n * n) for c in row] for row in centred])  # Python divides integers of any size correctly rounded
    values, vectors = np.linalg.eigh(v)
    order = [k for k in np.argsort(-values, kind="stable")[:most] if values[k] > LEAST * max(values.max(), 0.0)]
    trace = sum(centred[i][i] for i in range(dims)) / (n * n)
    return {"n": n, "sums": sums, "vectors": vectors[:, order], "values": values[order], "explained": values[order] / trace if order else values[order]}


def _centred(x: np.ndarray, fit: dict) -> np.ndarray:
    """n * x - S exactly: 64-bit where it fits, else Python integers."""
    n, sums = fit["n"], fit["sums"]
    most = max(int(x.max()), -int(x.min())) * n + max(map(abs, sums)) if len(x) else 0
    return (x if most < 1 << 62 else x.astype(object)) * n - np.array(sums, np.int64 if most < 1 << 62 else object)[None, :]


def _projected(centred: np.ndarray, fit: dict) -> np.ndarray:
    return (centred.astype(np.float64) / fit["n"]) @ fit["vectors"] / np.sqrt(fit["values"])


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row per usable vector and component.

    Vectors that are null or empty, or hold null, non-finite or huge entries (integers beyond 2^40), take no part. Those of each
    length are fitted apart; the fit list is each different vector of integers once. Components without variance are left
    out, so vectors of a length of which there is one kind alone have no rows. deviation is null where it doesn't fit a
    long. Repeated and null vec_ids come back as often as they come; other columns are ignored; an empty table gives an
    empty result. The driver gets d * d / 2 sums of each length, no vectors.
    """
    spark = vectors.sparkSession
    on_workers(spark)
    x = integers(vectors.select(F.col(key).alias("vec_id"), F.col(column).alias("v")), "vec_id", "v").withColumn("vec_id", F.col("vec_id").cast("long"))
    distinct = stage(x.select("x").distinct())
    partial = distinct.mapInArrow(_scatter, "dims int, i int, j int, value string")
    found = partial.groupBy("dims", "i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    sums: dict[int, dict] = {}
    for r in found:
        sums.setdefault(r["dims"], {})[r["i"], r["j"]] = int(r["value"])
    fits = {d: _components(s[-1, -1], [s[i, -1] for i in range(d)], s, components) for d, s in sums.items()}

    def squares(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            dims_of = b.column(0).value_lengths().to_numpy()
            for dims in np.unique(dims_of).tolist():
                w = _projected(_centred(_matrix(b.column(0).filter(pa.array(dims_of == dims))), fits[dims]), fits[dims])
                total[dims] = total.get(dims, 0) + w.T @ w
        for dims, t in total.items():
            k = np.arange(t.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, dims, np.int32)), pa.array(k), pa.array(t.ravel())], names=["dims", "k", "value"])

    for r in distinct.mapInArrow(squares, "dims int, k int, value double").groupBy("dims", "k").agg(F.sum("value").alias("value")).collect():
        fit = fits[r["dims"]]
        same = r["k"] // len(fit["values"]) == r["k"] % len(fit["values"])
        fit["error"] = max(fit.get("error", 0.0), abs(r["value"] / fit["n"] - same))

    def project(batches):
        for b in batches:
            dims_of = b.column(1).value_lengths().to_numpy()
            for dims in np.unique(dims_of).tolist():
                own, fit = pa.array(dims_of == dims), fits[dims]
                k = len(fit["values"])
                centred = _centred(_matrix(b.column(1).filter(own)), fit)
                deviation = [d if d < 1 << 63 else None for d in (int(v) for v in (centred.astype(object) ** 2).sum(axis=1))]
                rows = len(centred)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).filter(own).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, fit["n"])),
                        pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(_projected(centred, fit).ravel()), pa.array(np.tile(fit["explained"], rows)),
                        pa.array(np.full(rows * k, fit.get("error", 0.0))),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.select("vec_id", "x").mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
