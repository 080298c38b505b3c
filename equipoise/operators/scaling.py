"""Whole-column scaling.

All scalars of a call come from ONE aggregate job (like ``MinMaxScaler.fit`` /
``StandardScaler.fit`` in Spark ML); the transform then uses them as literals,
so the per-row work stays a fused projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_extremes(df: DataFrame, cols: Sequence[str]) -> dict:
    """min/max of each column from one aggregate (NULL-skipping)."""
    aggs = []
    for i, c in enumerate(cols):
        value = F.when(~F.isnan(F.col(c).cast("double")), F.col(c))  # NaN would be the largest value
        aggs += [F.min(value).alias(f"mn{i}"), F.max(value).alias(f"mx{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"mn{i}"], row[f"mx{i}"]) for i, c in enumerate(cols)}


def minmax_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_NORMALIZED",
                 zero_range: str = "null") -> DataFrame:
    """(x - min) / (max - min) over the whole column.

    ``zero_range`` decides a constant column (Q16): ``"null"`` (unguarded form,
    which gives NaN in pandas) or ``"zero"`` (guarded social indices).
    """
    return minmax_scale_spec(df, {c: (c + suffix, zero_range) for c in cols})


def minmax_scale_spec(df: DataFrame, spec: dict, extremes: dict | None = None) -> DataFrame:
    """D5 for many columns in ONE aggregate: ``spec`` maps column -> (target, zero_range mode).

    Modes for a constant column: ``"null"`` -> NULL (pandas NaN), ``"zero"`` -> 0 on
    every row (the guarded social indices), ``"sklearn"`` -> 0 where the value is
    present (``MinMaxScaler`` treats a zero range as 1).  ``extremes`` (column ->
    (min, max)) skips the aggregate, e.g. to scale a stream like a reference batch.
    """
    cols = list(spec)
    ext = extremes if extremes is not None else column_extremes(df, cols)
    out = []
    for c in cols:
        target, mode = spec[c]
        mn, mx = ext[c]
        if mn is None or mx is None:
            e = F.lit(None).cast("double")
        elif mx - mn == 0:
            e = {"zero": F.lit(0.0), "sklearn": F.when(F.col(c).isNotNull(), F.lit(0.0))}.get(
                mode, F.lit(None).cast("double"))
        else:
            e = (F.col(c) - F.lit(float(mn))) / F.lit(float(mx - mn))
        out.append(e.alias(target))
    keep = [c for c in df.columns if c not in {t for t, _ in spec.values()}]
    return df.select(*keep, *out)


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population sd (``StandardScaler``); a zero-sd column becomes 0."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    exprs = []
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if m is None:
            e = F.lit(None).cast("double")
        elif not s or s == 0:
            e = F.when(F.col(c).isNotNull(), F.lit(0.0))
        else:
            e = (F.col(c) - F.lit(float(m))) / F.lit(float(s))
        exprs.append(e.alias(c + suffix))
    keep = [c for c in df.columns if c not in {c + suffix for c in cols}]
    return df.select(*keep, *exprs)
