"""Weighted centred moments of two columns, per key, in one reading of the rows.

A task keeps for each key n, the weight, both means, and the centred sums of squares and products.  A batch's moments
are merged into the task's by the pairwise update, so that no large sums of squares are ever subtracted.  Tasks send one
row per key, and rows of the same key are merged the same way in the JVM: around their common mean.  Keys can be merged
further, as cells into the levels of each of their columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys a task holds before it sends them on.
HELD_KEYS = 50_000
_SUMS = ("n", "w", "mx", "my", "sxx", "sxy", "syy", "largest")
_N, _W, _MX, _MY, _SXX, _SXY, _SYY, _LARGEST = range(8)


def _batch_moments(x: np.ndarray, y: np.ndarray, w: np.ndarray, key: np.ndarray, keys: int) -> np.ndarray:
    """(keys x 8) moments of one batch."""
    def total(values):
        return np.bincount(key, values, minlength=keys)

    out = np.zeros((keys, 8))
    out[:, _N], out[:, _W] = np.bincount(key, minlength=keys), total(w)
    safe = np.where(out[:, _W] != 0, out[:, _W], 1.0)
    out[:, _MX], out[:, _MY] = total(w * x) / safe, total(w * y) / safe
    dx, dy = x - out[key, _MX], y - out[key, _MY]
    # what rounding left of the means
    ex, ey = total(w * dx), total(w * dy)
    out[:, _SXX], out[:, _SXY], out[:, _SYY] = (total(w * dx * dx) - ex * ex / safe, total(w * dx * dy) - ex * ey / safe,
                                                total(w * dy * dy) - ey * ey / safe)
    np.maximum.at(out[:, _LARGEST], key, np.abs(x))
    return out


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of rows from those of each."""
    w = a[:, _W] + b[:, _W]
    safe = np.where(w != 0, w, 1.0)
    dx, dy = b[:, _MX] - a[:, _MX], b[:, _MY] - a[:, _MY]
    out, share, both = a + b, b[:, _W] / safe, a[:, _W] * b[:, _W] / safe
    out[:, _MX], out[:, _MY] = a[:, _MX] + dx * share, a[:, _MY] + dy * share
    out[:, _SXX] += dx * dx * both
    out[:, _SXY] += dx * dy * both
    out[:, _SYY] += dy * dy * both
    out[:, _LARGEST] = np.maximum(a[:, _LARGEST], b[:, _LARGEST])
    return out


def partial_moments(df: DataFrame, x: str, y: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` and the moments _SUMS of each task's rows, without rows that lack x, y or the weight; NULL is a key like others."""
    fields = [df.schema[k] for k in keys]
    names = [f"k{i}" for i in range(len(fields))]
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, fields)),
                           *(T.StructField(s, T.LongType() if s == "n" else T.DoubleType()) for s in _SUMS)])
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)],
                     *[F.col(f"`{c}`").cast("double").alias(a) for c, a in ((x, "x"), (y, "y"), (weight, "w"))])
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.column(n).type for n in names]
            # rows of equal keys get one number
            code = np.zeros(batch.num_rows, np.int64)
            for n in names:
                column = batch.column(n).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(column.dictionary) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            _, first, code = np.unique(code, return_index=True, return_inverse=True)
            found = [batch.column(n).take(pa.array(first)).to_pylist() for n in names]
            own = list(zip(*found)) if names else [()]
            moments = _batch_moments(*(batch.column(c).to_numpy() for c in ("x", "y", "w")), code, len(own))
            empty = np.zeros(8)
            before = np.stack([held.get(k, empty) for k in own])
            for k, row in zip(own, np.where(before[:, :1] > 0, _merged(before, moments), moments)):
                held[k] = row
            if len(held) > HELD_KEYS:
                yield _rows(held, names, kinds)
                held = {}
        if held:
            yield _rows(held, names, kinds)

    sent = rows.mapInArrow(measure, schema)
    return sent.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *_SUMS)


def _rows(held: dict, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    values = np.stack(list(held.values()))
    columns = {n: pa.array([k[i] for k in held], kind) for i, (n, kind) in enumerate(zip(names, kinds))}
    columns |= {s: pa.array(values[:, i].astype(np.int64) if s == "n" else values[:, i]) for i, s in enumerate(_SUMS)}
    return pa.record_batch(columns)


def merged_moments(partial: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per value of ``keys`` (none: one row, if there are any rows): the moments of all rows of ``partial`` with it.

    The rows meet once, by key: a task sends one row a key.
    """
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    weight = F.sum("w").over(whole)
    centred = partial.withColumns({"cx": F.try_divide(F.sum(F.col("w") * F.col("mx")).over(whole), weight),
                                   "cy": F.try_divide(F.sum(F.col("w") * F.col("my")).over(whole), weight)})
    dx, dy, w = F.col("mx") - F.col("cx"), F.col("my") - F.col("cy"), F.col("w")
    sums = centred.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.first("cx").alias("cx"), F.first("cy").alias("cy"),
        F.sum(w * dx).alias("ex"), F.sum(w * dy).alias("ey"), F.sum(F.col("sxx") + w * dx * dx).alias("sxx"),
        F.sum(F.col("sxy") + w * dx * dy).alias("sxy"), F.sum(F.col("syy") + w * dy * dy).alias("syy"), F.max("largest").alias("largest"))
    ex, ey = F.try_divide("ex", "w"), F.try_divide("ey", "w")
    return sums.where("n > 0").select(
        *keys, "n", "w", (F.col("cx") + ex).alias("mx"), (F.col("cy") + ey).alias("my"),
        *[F.greatest(F.col(s) - F.coalesce(F.col(e) * m, F.lit(0.0)), F.lit(0.0)).alias(s) for s, e, m in (("sxx", "ex", ex), ("syy", "ey", ey))],
        (F.col("sxy") - F.coalesce(F.col("ex") * ey, F.lit(0.0))).alias("sxy"), "largest")


def moments(df: DataFrame, x: str, y: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted moments of ``x`` and ``y`` per value of ``keys``: n, w, mx, my, sxx, syy, sxy, and the largest absolute x."""
    return merged_moments(partial_moments(df, x, y, weight, keys), keys)
