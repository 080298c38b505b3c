"""Column expressions for coded survey answers.

Every function returns a native ``Column``; nothing here runs Python per row.
Rule shared by all dictionaries: a code that is not listed maps to NULL
(keys such as ``None``, NaN, ``''`` or ``'BLANK'`` in a dictionary are ignored,
since they map to NULL anyway).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _is_null_key(k) -> bool:
    return k is None or k == "" or k == "BLANK" or (isinstance(k, float) and math.isnan(k))


def recode(col: str | Column, mapping: Mapping, default=None) -> Column:
    """Map code -> value by dictionary; unlisted codes -> ``default`` (NULL unless given)."""
    c = _c(col)
    out = None
    for k, v in mapping.items():
        if _is_null_key(k):
            continue
        val = F.lit(None) if v is None or (isinstance(v, float) and math.isnan(v)) else F.lit(v)
        out = F.when(c == F.lit(k), val) if out is None else out.when(c == F.lit(k), val)
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default)) if default is not None else out


def recode_range_as_text(col: str | Column, lo: int, hi: int, extra: Mapping | None = None) -> Column:
    """Codes lo..hi -> their own text ('1', '2', ...); ``extra`` maps further codes; others NULL."""
    c = _c(col)
    out = F.when(c.between(lo, hi) & (c == F.floor(c)), c.cast("long").cast("string"))
    for k, v in (extra or {}).items():
        if not _is_null_key(k):
            out = out.when(c == F.lit(k), F.lit(v))
    return out


def null_codes(col: str | Column, codes: Iterable) -> Column:
    """Special codes (e.g. 7777, 9999) -> NULL, other values kept."""
    c = _c(col)
    return F.when(~c.isin(list(codes)), c)


def indicator(col: str | Column, code=1) -> Column:
    """1 when the code equals ``code``, else 0 (NULL -> 0)."""
    return F.when(_c(col) == F.lit(code), F.lit(1)).otherwise(F.lit(0))


def flag_index(cols: Sequence[str | Column], code=1, denominator: int | None = None) -> Column:
    """Count of indicator flags divided by the full list length (or ``denominator``)."""
    total = sum((indicator(c, code) for c in cols), F.lit(0))
    return total / F.lit(float(denominator or len(cols)))


def any_positive(cols: Sequence[str | Column]) -> Column:
    """1 when any column is > 0; missing values and NaN count as not positive (Q1)."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce((_c(c) > 0) & ~F.isnan(_c(c).cast("double")), F.lit(False))
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def threshold_flag(col: str | Column, threshold: float) -> Column:
    """1 when value <= threshold, else 0; NULL -> 0 (Q1)."""
    return F.when(_c(col) <= F.lit(threshold), F.lit(1)).otherwise(F.lit(0))


def _as_int(col: str | Column) -> Column:
    return _c(col).try_cast("int")


def weekly_rate(col: str | Column, weeks_per_month: float = 4.345, never_code: int | None = None) -> Column:
    """1xx -> xx per week, 2xx -> xx per month / weeks_per_month, ``never_code`` -> 0, else NULL."""
    v = _as_int(col)
    out = F.when(v.between(101, 199), (v - 100).cast("double")).when(
        v.between(201, 299), (v - 200) / F.lit(weeks_per_month))
    if never_code is not None:
        out = out.when(v == F.lit(never_code), F.lit(0.0))
    return out


def minutes(col: str | Column) -> Column:
    """1..759 are minutes as is (Q8), 800..959 -> (v - 800) * 60, else NULL."""
    v = _as_int(col)
    return F.when(v.between(1, 759), v.cast("double")).when(v.between(800, 959), ((v - 800) * 60).cast("double"))


def day_scale(col: str | Column, special: Iterable = (77, 88, 99), top: int = 30) -> Column:
    """Special codes -> NULL, 1..top -> v / top, else NULL."""
    v = _c(col).try_cast("double")
    return F.when(v.isin(list(special)), F.lit(None).cast("double")).when(v.between(1, top), v / F.lit(float(top)))


def in_range_or_zero(col: str | Column, lo: int = 1, hi: int = 30, scale: float | None = 30.0) -> Column:
    """B13 variant: value kept when it is one of lo..hi, else 0 (NULL -> 0); then / scale."""
    c = _c(col)
    kept = F.when(c.isin(list(range(lo, hi + 1))), c.cast("double")).otherwise(F.lit(0.0))
    return kept / F.lit(scale) if scale else kept


def first_non_null_score(a: str | Column, b: str | Column, mapping: Mapping, default=0) -> Column:
    """First non-null of two answers, then score by dictionary; anything else -> ``default``."""
    return recode(F.coalesce(_c(a), _c(b)), mapping, default=default)


def to_number(col: str | Column) -> Column:
    """Coerce to double, bad text -> NULL (``pd.to_numeric(errors='coerce')``)."""
    return _c(col).try_cast("double")


def member_flag(col: str | Column, codes: Iterable[int]) -> Column:
    """Integer part of the value is in ``codes``; NULL -> False."""
    return F.coalesce(_c(col).try_cast("int").isin(list(codes)), F.lit(False))


def blank_as_null(col: str | Column) -> Column:
    """Q3: empty strings become NULL at stage borders (as a CSV hand-off would do)."""
    c = _c(col)
    return F.when(c != F.lit(""), c)


def nan_as_null(col: str | Column) -> Column:
    """Q1: NaN -> NULL on ingest (Spark orders NaN above every number)."""
    c = _c(col)
    return F.when(~F.isnan(c), c)


def finite_or_null(col: str | Column) -> Column:
    """H7: +-infinity and NaN -> NULL."""
    c = _c(col)
    return F.when(~F.isnan(c) & (c != F.lit(float("inf"))) & (c != F.lit(float("-inf"))), c)


def clean_name(col: str | Column) -> Column:
    """H1: lower case, drop '(...)' parts and anything but [a-z0-9 ], spaces -> '_' (snake name)."""
    c = F.lower(_c(col))
    c = F.regexp_replace(c, r"\(.*?\)", "")
    c = F.regexp_replace(c, r"[^a-z0-9 ]+", "")
    return F.regexp_replace(F.trim(c), r"\s+", "_")


def strip_html(col: str | Column) -> Column:
    """H2: drop tags, decode the common named entities, non-breaking space -> space, trim."""
    return decode_entities(F.regexp_replace(_c(col), r"<[^>]*>", ""))


def decode_entities(col: str | Column) -> Column:
    """Decode &nbsp; &lt; &gt; &quot; &#39; &amp; (in that order), non-breaking space -> space, trim."""
    c = _c(col)
    c = F.replace(c, F.lit("&nbsp;"), F.lit(" "))
    c = F.replace(c, F.lit("\u00a0"), F.lit(" "))
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return F.trim(c)


def fixed_bins(col: str | Column, edges: Sequence[float], labels: Sequence[str], right: bool = True) -> Column:
    """Label by fixed edges; right-closed ``(e_i, e_i+1]`` by default, outside -> NULL (Q10)."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    c = _c(col)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi) if right else (c >= lo) & (c < hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out
