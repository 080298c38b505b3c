"""Equi-joins that stay balanced when one key holds a large share of the rows.

``hot_key_join`` counts the big side per key (map-side combined), takes the
keys above ``share`` of its rows -- there are at most ``1 / share`` of them, so
the list is bounded by construction -- and joins those rows against a
broadcast of the matching small-side rows (size-checked; beyond the limit both
sides of the hot keys are salted), while every other
key goes through the ordinary shuffle join.  The hot rows are thereby spread
over all tasks of the big side instead of landing in one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.session import fits_broadcast

SALTS = 32  # tasks over which a hot key's rows are dealt when its other side is too large to broadcast
DEFAULT_SHARE = 0.01  # a key is hot when it holds more than 1% of the big side -> at most 100 hot keys


def hot_keys(big: DataFrame, keys: Sequence[str], share: float = DEFAULT_SHARE, min_rows: int = 10_000) -> list:
    """Keys whose row count exceeds ``max(share * n, min_rows)`` (at most ``1 / share`` of them).

    A side with no more than that many rows in total cannot have a hot key, so
    the per-key count (a map-side-combined aggregate) only runs on bigger sides.
    """
    total = big.count()
    cut = max(int(share * total), min_rows)
    if total <= cut:
        return []
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return [tuple(r[k] for k in keys) for r in counts.where(F.col("_n") > cut).select(*keys).collect()]


def _key_filter(keys: Sequence[str], values: list):
    if len(keys) == 1:
        return F.col(keys[0]).isin([v[0] for v in values])
    cond = F.lit(False)
    for v in values:
        one = F.lit(True)
        for k, x in zip(keys, v):
            one = one & (F.col(k) == F.lit(x))
        cond = cond | one
    return cond


def hot_keys_from_counts(counts: DataFrame, keys: Sequence[str], count_col: str, share: float = DEFAULT_SHARE,
                         min_rows: int = 10_000, total: int | None = None) -> list:
    """``hot_keys`` from an already aggregated (key, count) frame -- e.g. one the caller has cached.

    ``total`` (the sum of the counts, when the caller knows it) skips one job.
    """
    if total is None:
        total = counts.agg(F.sum(count_col)).first()[0] or 0
    cut = max(int(share * total), min_rows)
    if total <= cut:
        return []
    return [tuple(r[k] for k in keys) for r in counts.where(F.col(count_col) > cut).select(*keys).collect()]


def hot_key_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
                 share: float = DEFAULT_SHARE, min_rows: int = 10_000, hot: list | None = None) -> DataFrame:
    """Join ``big`` to ``small`` on ``keys``; rows of hot keys use a broadcast join of their small-side rows.

    ``hot`` passes hot keys the caller already knows (skips counting ``big``).
    """
    keys = list(keys)
    if hot is None:
        hot = hot_keys(big, keys, share, min_rows)
    if not hot:
        return big.join(small, keys, how)
    is_hot = _key_filter(keys, hot)
    small_hot = small.where(is_hot)
    if fits_broadcast(small_hot):
        hot_part = big.where(is_hot).join(F.broadcast(small_hot), keys, how)
    else:  # too much to broadcast: a hot key's rows are dealt over SALTS keys, its small side is repeated for each
        # by the row's own columns: a task that runs again deals its rows as before
        salted = big.where(is_hot).withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(SALTS)))
        repeated = small_hot.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hot_part = salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
    cold = F.coalesce(~is_hot, F.lit(True))  # a NULL key is never hot (kept by outer joins)
    cold_part = big.where(cold).join(small.where(cold), keys, how)
    return hot_part.unionByName(cold_part)


def join_bounded(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
                 known_rows: int | None = None) -> DataFrame:
    """Broadcast ``small`` under a proven row bound; beyond it a shuffle join with hot keys split out."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if fits_broadcast(small, known_rows=known_rows):
        return big.join(F.broadcast(small), keys, how)
    return hot_key_join(big, small, keys, how)
