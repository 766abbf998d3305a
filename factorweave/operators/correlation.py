"""Correlations of many columns at once, and choices among correlated ones."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorweave.functions.stats import finite


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows; missing values are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


_SUMS = "i int, n array<double>, own array<double>, other array<double>, own_sq array<double>, other_sq array<double>, both array<double>"


def _products(shift: np.ndarray, scale: np.ndarray, left: slice, right: slice):
    """Sums over a task's rows for each pair of a left and a right column, over the rows that have both.

    They are products of matrices: of the values, their squares and the marks of what is there.
    """

    def rows(batches):
        shape = (left.stop - left.start, right.stop - right.start)
        sums = [np.zeros(shape) for _ in range(6)]
        for batch in batches:
            x = (_matrix(batch.column(0)) - shift) / scale
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            (a, b), (p, q) = (x[:, left], x[:, right]), (there[:, left].astype(float), there[:, right].astype(float))
            for s, u, v in zip(sums, (p, a, p, a * a, p, a), (q, q, b, q, b * b, b), strict=True):
                s += u.T @ v
        lists = [pa.array(list(s), pa.list_(pa.float64())) for s in sums]
        yield pa.record_batch([pa.array(np.arange(left.start, left.stop), pa.int32()), *lists], names=[f.split()[0] for f in _SUMS.split(", ")])

    return rows


def _correlations(right: slice):
    def rows(key, table):
        """(i, j, corr) of one left column, from the sums of all tasks."""
        i = key[0].as_py()
        n, a, b, aa, bb, ab = (_matrix(table[c]).sum(0) for c in table.column_names[1:])
        some = np.maximum(n, 1)
        va, vb, c = aa / some - (a / some) ** 2, bb / some - (b / some) ** 2, ab / some - a * b / some**2
        ok = (n > 1) & (va > 1e-12 * aa / some) & (vb > 1e-12 * bb / some)
        corr = np.where(ok, c / np.sqrt(np.where(ok, va * vb, 1.0)), np.nan)
        j = np.arange(right.start, right.stop)
        later = j > i
        return pa.table({"i": pa.array(np.full(later.sum(), i), pa.int32()), "j": pa.array(j[later], pa.int32()), "corr": pa.array(np.clip(corr[later], -1.0, 1.0), from_pandas=True)})

    return rows


def correlation_matrix(df: DataFrame, cols: list[str], together: int = 1024) -> DataFrame:
    """(a, b, corr) of each pair of columns, a before b in cols, over the rows that have both.

    One pass sums six products of matrices in each task: memory of 48 bytes for each pair of up to
    `together` columns; more columns take a pass for each pair of blocks.  Values are shifted by
    their mean first, so that sums keep their digits.  NaN and infinity count as missing; a
    pair has null where either column is constant on the common rows (in 12 digits).
    """
    k = len(cols)
    spark, empty = df.sparkSession, "a string, b string, corr double"
    if k < 2:
        return spark.createDataFrame([], empty)
    own = df.select(F.array(*[finite(F.col(f"`{c}`")) for c in cols]).alias("x"))

    def sums(batches):
        n, s, q = np.zeros(k), np.zeros(k), np.zeros(k)
        for batch in batches:
            x = _matrix(batch.column(0))
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            n, s, q = n + there.sum(0), s + x.sum(0), q + (x * x).sum(0)
        yield pa.record_batch([pa.array(np.arange(k), pa.int32()), pa.array(n), pa.array(s), pa.array(q)], names=["i", "n", "s", "q"])

    got = own.mapInArrow(sums, "i int, n double, s double, q double").groupBy("i").agg(*[F.sum(c).alias(c) for c in "nsq"]).orderBy("i").toArrow()  # a row a column
    n, s, q = (np.asarray(got[c].to_numpy(), float) for c in "nsq")
    if not len(n):
        n = s = q = np.zeros(k)
    shift = s / np.maximum(n, 1)
    with np.errstate(invalid="ignore"):
        scale = np.sqrt(q / np.maximum(n, 1) - shift**2)
    scale = np.where(np.isfinite(scale) & (scale > 0), scale, 1.0)
    blocks = [slice(a, min(a + together, k)) for a in range(0, k, together)]
    parts = []
    for left, right in itertools.combinations_with_replacement(blocks, 2):
        parts.append(own.mapInArrow(_products(shift, scale, left, right), _SUMS).groupBy("i").applyInArrow(_correlations(right), "i int, j int, corr double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    names = F.array(*[F.lit(c) for c in cols])
    return out.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "corr")


def correlated(vectors: DataFrame, threshold: float, block: int = 512, name_col: str = "factor", vector_col: str = "pc") -> DataFrame:
    """(a, b) of vectors whose correlation is beyond the threshold, up or down; names are unique.

    Vectors stay in tasks: they are dealt in blocks, each pair of blocks meets in one task as a
    product of unit vectors, and only pairs beyond the threshold are sent on.  A constant
    vector correlates with none.
    """
    own = vectors.select(F.col(f"`{name_col}`").alias("name"), F.col(f"`{vector_col}`").alias("v"))
    blocks = max(1, -(-own.count() // block))
    own = own.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"))
    tiles = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "name", "v")

    def rows(key, table):
        x = _matrix(table["v"])
        x = np.where(x.max(1, keepdims=True) > x.min(1, keepdims=True), x - x.mean(1, keepdims=True), 0.0)
        size = np.sqrt((x * x).sum(1, keepdims=True))
        x = x / np.where(size > 0, size, 1.0)
        name, side = np.array(table["name"].to_pylist(), object), table["block"].to_numpy()
        first = side == key[0].as_py()
        i, j = np.nonzero(np.abs(x[first] @ x.T) > threshold)
        i = np.flatnonzero(first)[i]
        ok = (side[j] != side[i]) if key[0].as_py() != key[1].as_py() else (name[i] < name[j])
        return pa.table({"a": pa.array(name[i[ok]].tolist(), pa.string()), "b": pa.array(name[j[ok]].tolist(), pa.string())})

    return tiles.groupBy("low", "high").applyInArrow(rows, "a string, b string")


def independent(order: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Names, in order, that no kept one before them shares an edge with."""
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept: set[str] = set()
    for name in order:
        if not near.get(name, set()) & kept:
            kept.add(name)
    return [n for n in order if n in kept]
