"""Row-wise combinations of several columns, as native expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def _present(col) -> Column:
    """The value as double; NaN counts as missing (Q1)."""
    x = _c(col).cast("double")
    return F.when(~F.isnan(x), x)


def row_sum(cols: Sequence) -> Column:
    """Sum skipping NULLs; a row with every part NULL sums to 0 (Q6)."""
    return sum((F.coalesce(_present(c), F.lit(0.0)) for c in cols), F.lit(0.0))


def non_null_count(cols: Sequence) -> Column:
    return sum((F.when(_present(c).isNotNull(), F.lit(1)).otherwise(F.lit(0)) for c in cols), F.lit(0))


def row_mean(cols: Sequence) -> Column:
    """Mean of the non-NULL parts; a row with every part NULL gives NULL (Q6)."""
    return F.try_divide(row_sum(cols), F.nullif(non_null_count(cols), F.lit(0)).cast("double"))


def weighted_mean(weights) -> Column:
    """sum(w * x) / sum(w) over the parts that are not NULL (weights renormalised).

    A row where no part is present gives NULL.  ``weights`` maps column -> weight,
    or is a sequence of (column or Column expression, weight) pairs.
    """
    pairs = list(weights.items()) if isinstance(weights, Mapping) else list(weights)
    num = sum((F.coalesce(_present(c) * F.lit(float(w)), F.lit(0.0)) for c, w in pairs), F.lit(0.0))
    den = sum((F.when(_present(c).isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in pairs), F.lit(0.0))
    return F.when(den > 0, num / den)


def scaled_part(col, lo: float, hi: float, divisor: float) -> Column:
    """A part of a severity score: value / divisor when lo <= value <= hi, else NULL."""
    c = _c(col)
    return F.when(c.between(lo, hi), c / F.lit(float(divisor)))


def frequency_part(col, weeks_per_month: float, divisor: float) -> Column:
    """1xx -> xx, 2xx -> xx / weeks_per_month, both / divisor; else NULL (alcohol frequency)."""
    c = _c(col)
    return F.when(c.between(101, 199), (c - 100) / F.lit(float(divisor))).when(
        c.between(201, 299), (c - 200) / F.lit(weeks_per_month) / F.lit(float(divisor)))
