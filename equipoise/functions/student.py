"""Tail of Student's t distribution as a column expression.

The two-sided p-value is the incomplete beta function I_z(v / 2, 1 / 2) at z = v / (v + t^2), by its continued fraction in the
modified Lentz form.  The fraction converges in about sqrt(v) steps where z is below (a + 1) / (a + b + 2), and the
symmetric one (a and b exchanged, 1 - z) elsewhere.  Steps run inside a fold over a sequence, so the expression has a fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
#: Factors taken out before the series of the gamma ratio is used.
_SHIFT = 12


def log_gamma_ratio(a: Column) -> Column:
    """log(Gamma(a + 1/2) / Gamma(a)) for a > 0.

    The asymptotic series at a + _SHIFT, where its next term is below 1e-13, and the recurrence of both from there down.
    """
    s = a + _SHIFT
    r = 1 / (s * s)
    series = F.log(s) / 2 - (1 / s) * (1 / 8 - r * (1 / 192 - r * (1 / 640 - r * (17 / 14336))))
    down = sum((F.log1p(0.5 / (a + j)) for j in range(_SHIFT)), F.lit(0.0))
    return series - down


def _beta_fraction(z: Column, a: Column, b: Column, steps: Column) -> Column:
    """The continued fraction of I_z(a, b), after its leading factor."""
    def away(x: Column) -> Column:
        return F.when(F.abs(x) < _TINY, _TINY).otherwise(x)

    def step(s: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))
        return F.transform(F.array(s), lambda s: F.struct(
            (1 / away(1 + even * s["d"])).alias("d"), away(1 + even / s["c"]).alias("c"), s["h"].alias("h"), odd.alias("odd")))[0]

    def finish(s: Column) -> Column:
        after = s["h"] * s["d"] * s["c"]
        return F.transform(F.array(F.struct((1 / away(1 + s["odd"] * s["d"])).alias("d"), away(1 + s["odd"] / s["c"]).alias("c"), after.alias("h"))),
                           lambda s: F.struct(s["d"].alias("d"), s["c"].alias("c"), (s["h"] * s["d"] * s["c"]).alias("h")))[0]

    d0 = 1 / away(1 - (a + b) * z / (a + 1))
    start = F.struct(d0.alias("d"), F.lit(1.0).alias("c"), d0.alias("h"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), steps), start, lambda s, m: finish(step(s, m)))["h"]


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for ``df`` degrees of freedom; NULL where t or df is NULL or df isn't positive; 1 at t = 0, 0 at infinity."""
    t, v = F.abs(t.cast("double")), df.cast("double")
    a, b = v / 2, F.lit(0.5)
    z, rest = v / (v + t * t), t * t / (v + t * t)
    steps = F.ceil(F.sqrt(v) * 4 + 60).cast("long")
    lead = a * F.log(z) + F.log(rest) / 2 + log_gamma_ratio(a) - math.log(math.pi) / 2
    tail = F.exp(lead) * _beta_fraction(z, a, b, steps) / a
    other = 1 - F.exp(lead) * _beta_fraction(rest, b, a, steps) / b
    p = F.when(z < (a + 1) / (a + b + 2), tail).otherwise(other)
    return F.when(t.isNotNull() & (v > 0), F.when(t == 0, 1.0).when(t == float("inf"), 0.0).otherwise(F.greatest(p, F.lit(0.0))))
