"""Global running sums and row numbers without a single-partition window, in one shuffle of the data.

Spark's ``row_number().over(Window.orderBy(...))`` without ``partitionBy`` moves
every row to one task.  ``cumulative_sum`` instead cuts the order into buckets: the
bounds are full sort keys taken from a sorted sample, so even one hot leading key is
split, and a row's bucket is a deterministic expression of its key.  The rows are
shuffled once, by bucket, for a window inside each; the buckets' totals (at most
buckets + groups rows) are a map-side combined aggregate of their own and become the
offsets.  A task that runs again computes the same buckets, so nothing has to be
checkpointed.  The input is read three times (sample, totals, window): pass a table
that is cheap to read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equipoise.session import join_small, reliable_checkpoint

_BUCKET = "_eq_bucket"
_TOT = "_eq_tot"
_OFF = "_eq_off"
_LOC = "_eq_loc"
#: Buckets at most: their bounds are part of the plan.
MAX_BUCKETS = 256
#: Sampled rows a bucket; rows a bucket at least.
SAMPLED, LEAST_ROWS = 24, 20_000


def _as_cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _bounds(df: DataFrame, keys: Sequence[Column], buckets: int | None) -> list:
    """Sort keys that cut ``df`` into about equal buckets, in order (at most MAX_BUCKETS - 1 of them)."""
    rows = df.count()
    wanted = buckets or min(MAX_BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                            rows // LEAST_ROWS + 1)
    if wanted <= 1 or rows <= 1:
        return []
    named = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    share = min(1.0, 2.0 * wanted * SAMPLED / rows)
    # the sample is bounded by 2 * MAX_BUCKETS * SAMPLED keys and sorted by Spark's own order
    sample = named.sample(False, share, 7).orderBy(*named.columns).limit(8 * wanted * SAMPLED).collect()
    picked = [sample[len(sample) * i // wanted] for i in range(1, wanted)] if sample else []
    return list(dict.fromkeys(tuple(r) for r in picked))


def _bucket(df: DataFrame, keys: Sequence[Column], bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at or before a row's key, by a tree of comparisons."""
    types = [f.dataType for f in df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).schema.fields]
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        bound = F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(bounds[middle], types))])
        return F.when(key >= bound, between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(bounds))


def cumulative_sum(
    df: DataFrame,
    value: str | Column,
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    out: str = "cum",
    inclusive: bool = False,
    num_partitions: int | None = None,
    groups_bound: int | None = None,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows before (``inclusive``: up to) each row.

    Rows are ordered by ``order_by`` inside each ``partition_by`` group.  The
    order should be total (unique) for a deterministic result among ties.
    ``num_partitions`` sets the number of buckets.  ``groups_bound`` (a known upper
    bound on the number of groups) proves the size of the offsets table, so it is
    broadcast without counting it first.
    """
    order_cols = _as_cols(order_by)
    value_col = F.col(value) if isinstance(value, str) else value
    keys = [*(F.col(c) for c in partition_by), *order_cols]
    bounds = _bounds(df, keys, num_partitions)
    placed = df.withColumns({_LOC: value_col, _BUCKET: _bucket(df, keys, bounds)})

    totals = placed.groupBy(_BUCKET, *partition_by).agg(F.sum(_LOC).alias(_TOT))
    # one row per (bucket, group present in it): <= buckets + groups - 1 rows
    w_off = Window.partitionBy(*partition_by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_BUCKET, *partition_by, F.coalesce(F.sum(_TOT).over(w_off), F.lit(0)).alias(_OFF))

    end = Window.currentRow if inclusive else -1
    w_loc = Window.partitionBy(_BUCKET, *partition_by).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, end)
    local = placed.withColumn(_LOC, F.coalesce(F.sum(_LOC).over(w_loc), F.lit(0)))

    bound = None
    if not partition_by:
        bound = len(bounds) + 1
    elif groups_bound is not None:
        bound = len(bounds) + groups_bound
    joined = join_small(local, offsets, [_BUCKET, *partition_by], known_rows=bound)
    return joined.withColumn(out, F.col(_LOC) + F.col(_OFF)).drop(_BUCKET, _LOC, _OFF)


def row_index(df: DataFrame, order_by: Sequence[str | Column], partition_by: Sequence[str] = (),
              out: str = "row_id", num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_by`` order (A5: row id 0..n-1 when none exists)."""
    return cumulative_sum(df, F.lit(1).cast("long"), order_by, partition_by, out=out, num_partitions=num_partitions)


#: Rank error of the pivots as a share of the rows: one part in so many.
PIVOT_ACCURACY = 10_000


def _pivots(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, dict]:
    """Per column with a value: count, mean, std, min, max, and a bracket of values around each quantile; one reading.

    The brackets come from a mergeable sketch of bounded size, some ranks below and above each quantile.
    """
    wide = sorted({min(1.0, max(0.0, p + d / PIVOT_ACCURACY)) for p in probs for d in (-2, 2)})
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"),
                 F.max(x).alias(f"max{i}"), F.percentile_approx(x, wide, PIVOT_ACCURACY).alias(f"at{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        if row[f"n{i}"]:
            at = dict(zip(wide, row[f"at{i}"]))
            pairs = [(at[min(1.0, max(0.0, p - 2 / PIVOT_ACCURACY))], at[min(1.0, max(0.0, p + 2 / PIVOT_ACCURACY))]) for p in probs]
            out[c] = {k: row[f"{k}{i}"] for k in ("n", "mean", "std", "min", "max")} | {"brackets": pairs}
    return out


def bracket_counts(df: DataFrame, brackets: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(variable, value, inside, n): how often each value inside a bracket of its column occurs, and how many values lie before each
    bracket and behind the one before (value: the bracket's start, inside: 0).

    Values are counted in the tasks that read them: what is shuffled are the distinct values of the brackets.
    """
    parts = []
    for c, pairs in brackets.items():
        x, number, inside = F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"), F.lit(0)
        for lo, hi in sorted(set(pairs), reverse=True):
            here = (x >= lo) & (x <= hi)
            number = F.when(here, x).otherwise(F.when(x < lo, F.lit(lo)).otherwise(number))
            inside = F.when(here, 1).otherwise(F.when(x < lo, 0).otherwise(inside))
        parts.append(F.struct(F.lit(c).alias("variable"), number.alias("value"), inside.alias("inside")))
    long = df.select(F.inline(F.array(*parts))).where(F.col("value").isNotNull())
    return long.groupBy("variable", "value", "inside").agg(F.count(F.lit(1)).alias("n"))


def _disjoint(pairs: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(pairs):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def _select(df: DataFrame, stats: dict[str, dict], probs: Sequence[float]) -> dict[str, dict[float, float]]:
    """The exact quantiles of each column: the order statistics on both sides of each, interpolated.

    One pass counts the values in the brackets and between them; the counts of the brackets alone are sorted.  A bracket that
    turns out not to hold its order statistics is replaced by the column's whole range.
    """
    at = {c: {p: p * (s["n"] - 1) for p in probs} for c, s in stats.items()}
    need = {c: sorted({int(math.floor(h)) for h in hs.values()} | {int(math.ceil(h)) for h in hs.values()}) for c, hs in at.items()}
    found: dict[str, dict[int, float]] = {c: {} for c in stats}
    left = {c: _disjoint(s["brackets"]) for c, s in stats.items()}
    while left:
        counts = reliable_checkpoint(bracket_counts(df, left))
        placed = cumulative_sum(counts, "n", ["value", "inside"], partition_by=["variable"], out="_before", groups_bound=len(left))
        wanted = F.lit(False)
        for c in left:
            inside = F.lit(False)
            for p in need[c]:
                inside = inside | ((F.col("_before") <= p) & (F.col("_before") + F.col("n") > p))
            wanted = wanted | ((F.col("variable") == c) & inside)
        # at most two rows a quantile and column
        for r in placed.where((F.col("inside") == 1) & wanted).collect():
            for p in need[r["variable"]]:
                if r["_before"] <= p < r["_before"] + r["n"]:
                    found[r["variable"]][p] = r["value"]
        left = {c: [(stats[c]["min"], stats[c]["max"])] for c in left if len(found[c]) < len(need[c])}
    out: dict[str, dict[float, float]] = {}
    for c, hs in at.items():
        low, high = {p: found[c][math.floor(h)] for p, h in hs.items()}, {p: found[c][math.ceil(h)] for p, h in hs.items()}
        out[c] = {p: low[p] + (high[p] - low[p]) * (h - math.floor(h)) for p, h in hs.items()}
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/numpy default) for many columns at once, by selection.

    Returns one row per (variable, prob) with ``value``; a column without a value has none.
    """
    stats = _pivots(df, columns, probs)
    chosen = _select(df, stats, probs)
    rows = [(c, float(p), float(v)) for c, values in chosen.items() for p, v in values.items()]
    return df.sparkSession.createDataFrame(rows, "variable string, prob double, value double")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std (n-1), min, exact quartiles, max per column, one row per column that has a value.

    The input is read twice: for the plain figures and the quartiles' brackets, and for the counts in these.
    """
    stats = _pivots(df, columns, [0.25, 0.5, 0.75])
    chosen = _select(df, stats, [0.25, 0.5, 0.75])
    rows = [(c, s["n"], s["mean"], s["std"], s["min"], *chosen[c].values(), s["max"]) for c, s in stats.items()]
    return df.sparkSession.createDataFrame(
        rows, "variable string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
