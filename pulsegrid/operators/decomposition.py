"""Principal components and stable singular vectors from Gram matrices.

Rows are never gathered: a task adds up the products of its rows, block by block of a batch, the
parts are summed by place, and d x d numbers reach the driver, where their eigenvectors are
taken. Resamples are Poisson weights of the units that rows belong to, drawn by a hash, so all of
them are added up in the same reading.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.shared import ship

#: Chances of 0, 1, 2, ... in a Poisson distribution of mean one, summed up.
POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(8)]
#: Rows of a batch that are multiplied at a time.
ROWS = 4096


def drawn(unit: Column, boot: int) -> Column:
    """How often a resample takes a unit."""
    u = F.pmod(F.xxhash64(F.lit(boot), unit), F.lit(1 << 53)) / float(1 << 53)
    return sum(((u >= s).cast("int") for s in POISSON[1:]), (u >= POISSON[0]).cast("int"))


def gram(df: DataFrame, values: str, d: int, unit: Column | None = None, boots: int = 0) -> DataFrame:
    """(boot, i, j, total, n): the sums of products of the elements i and j of an array column, over
    all rows (boot -1) and over `boots` resamples of units. Element d is 1 for every row, so the
    sums and the number of rows are among the products. Rows that are null, hold a null or NaN
    or have another length are left out."""
    ship(df.sparkSession)
    weights = F.array(F.lit(1), *(drawn(unit, b) for b in range(boots)))
    rows = df.select(F.col(values).cast("array<double>").alias("x"), weights.alias("w"))
    rows = rows.where((F.size("x") == d) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((boots + 1, d + 1, d + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.ones((part.num_rows, d + 1))
                x[:, :d] = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                w = part.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, boots + 1)
                for b in range(boots + 1):
                    sums[b] += (x * w[:, b : b + 1]).T @ x
        if sums[0, d, d]:
            b, i, j = np.indices(sums.shape).reshape(3, -1)
            yield pa.RecordBatch.from_arrays([pa.array(b - 1, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums.ravel())], names=["boot", "i", "j", "total"])

    parts = rows.mapInArrow(work, "boot int, i int, j int, total double")
    return parts.groupBy("boot", "i", "j").agg(F.sum("total").alias("total"))


def matrices(products: DataFrame, d: int) -> dict[int, np.ndarray]:
    """The (d + 1) x (d + 1) matrices of gram() by resample."""
    found: dict[int, np.ndarray] = {}
    for boot, i, j, total in products.collect():  # (d + 1) squared numbers a resample
        found.setdefault(boot, np.zeros((d + 1, d + 1)))[i, j] = total
    return found


@dataclass
class Components:
    """Rows of `directions` are unit vectors, the strongest first; variances are along them."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray


def components(df: DataFrame, values: str, d: int, k: int | None = None, eigen_ratio: float = 1e6) -> Components:
    """Principal components of an array column: k of them (all, by default), or fewer, so that the
    largest variance is at most `eigen_ratio` times the smallest. ValueError for less than two rows."""
    whole = matrices(gram(df, values, d), d).get(-1)
    n = 0 if whole is None else whole[d, d]
    if n < 2:
        raise ValueError("components need two rows or more")
    mean = whole[d, :d] / n
    variances, vectors = np.linalg.eigh((whole[:d, :d] - n * np.outer(mean, mean)) / (n - 1))
    variances, vectors = variances[::-1], vectors[:, ::-1].T
    k = d if k is None else min(k, d)
    while k > 1 and not variances[0] <= eigen_ratio * variances[k - 1]:
        k -= 1
    signs = np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
    return Components(mean, (vectors * signs)[:k], variances[:k])


def whitened(df: DataFrame, values: str, found: Components, name: str = "white") -> DataFrame:
    """df with the components of an array column, centred and of variance one, in their order;
    null where a row has a null, NaN or another length."""
    ship(df.sparkSession)
    weights = found.directions / np.sqrt(found.variances)[:, None]
    d = weights.shape[1]
    x = F.col(values).cast("array<double>")
    fine = F.coalesce((F.size(x) == d) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v)), F.lit(False))
    centred = F.zip_with(x, F.array(*map(F.lit, found.mean.tolist())), lambda a, m: a - m)
    dot = lambda c, w: F.aggregate(F.zip_with(c, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    parts = F.transform(F.array(centred), lambda c: F.array(*(dot(c, w) for w in weights.tolist())))[0]
    return df.withColumn(name, F.when(fine, parts))


@dataclass
class Stable:
    """Singular vectors (rows, times their values), their ratio to the spread over resamples, and
    the false discovery rate of each element's ratio."""

    vectors: np.ndarray
    values: np.ndarray
    ratios: np.ndarray
    q: np.ndarray


def singular(whole: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows) of a matrix, from its Gram matrix."""
    squares, vectors = np.linalg.eigh(whole)
    return np.sqrt(np.maximum(squares[::-1][:k], 0)), vectors[:, ::-1][:, :k].T


def turned(base: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The rotation of the rows of `other` that brings them next to the rows of `base`."""
    u, _, v = np.linalg.svd(base @ other.T)
    return u @ v


def stable_vectors(df: DataFrame, values: str, d: int, unit: Column, k: int = 3, boots: int = 50) -> Stable:
    """The first k singular vectors of the rows, and which of their elements hold over resamples of
    units: each resample's vectors are turned next to the whole's, and an element counts by its
    size over its deviation; q is the rate of false discoveries among elements of that ratio or
    more (two-sided normal, centred on the median ratio). At most d vectors; d x d numbers of
    each resample reach the driver."""
    found = matrices(gram(df, values, d, unit, boots), d)
    if -1 not in found:
        raise ValueError("there are no rows")
    k = min(k, d)
    s, v = singular(found[-1][:d, :d], k)
    whole = s[:, None] * v
    turns = []
    for b in range(boots):
        if b in found:
            sb, vb = singular(found[b][:d, :d], k)
            turns.append(turned(v, vb) @ (sb[:, None] * vb))
    ratios = whole / np.maximum(np.std(turns, axis=0), 1e-300)
    p = np.array([math.erfc(abs(x) / math.sqrt(2)) for x in (ratios - np.median(ratios)).ravel()])
    order = np.argsort(p)
    q = np.empty_like(p)
    q[order] = np.minimum(1, np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
    return Stable(v, s, ratios, q.reshape(ratios.shape))
