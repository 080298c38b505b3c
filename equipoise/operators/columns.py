"""Column-set, filter and category-code operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.operators.joins import hot_key_join, join_bounded
from equipoise.operators.ranking import row_index
from equipoise.session import fits_broadcast, reliable_checkpoint


def available(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """Plan-time intersection: the wanted names that exist, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def select_available(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """B1: keep only the wanted columns that exist (pruned into the scan by Catalyst)."""
    return df.select(*available(df, wanted))


def drop_available(df: DataFrame, unwanted: Iterable[str]) -> DataFrame:
    """B2: drop the listed columns that exist."""
    return df.drop(*available(df, unwanted))


def filter_isin(df: DataFrame, col: str, values) -> DataFrame:
    """Keep rows whose ``col`` is in ``values``.

    A Python list becomes an ``IN`` predicate (pushed to the scan); a DataFrame
    of values becomes a semi-join, broadcast only when its size is checked.
    """
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias(col)).distinct()
        if fits_broadcast(keys):
            return df.join(F.broadcast(keys), col, "left_semi")
        return hot_key_join(df, keys, [col], "left_semi")  # long list: shuffle, hot values broadcast
    return df.where(F.col(col).isin(list(values)))


def complete_cases(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL (or NaN) in ``subset`` (all columns when None)."""
    cols = list(subset) if subset is not None else df.columns
    cond = F.lit(True)
    for c in cols:
        dt = df.schema[c].dataType.typeName()
        ok = F.col(c).isNotNull()
        if dt in ("double", "float"):
            ok = ok & ~F.isnan(c)
        cond = cond & ok
    return df.where(cond)


def category_mapping(df: DataFrame, cols) -> DataFrame:
    """B15 mapping table (variable, value, code): code = rank of the sorted distinct non-NULL values.

    All columns of one type are unpivoted and ranked together: distinct values
    are de-duplicated map-side and numbered by ONE distributed sort partitioned
    by variable, so even a high-cardinality column never funnels through one task.
    Values keep their own type (numbers sort as numbers).
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    parts = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {parts}) AS (variable, value)").where(F.col("value").isNotNull())
    return row_index(long.distinct(), ["value"], partition_by=["variable"], out="code").select(
        "variable", "value", F.col("code").cast("int").alias("code"))


def category_codes(df: DataFrame, cols: Sequence[str], suffix: str = "", keep_mapping: bool = False):
    """Replace each categorical column by its integer code (NULL stays NULL).

    Codes are computed on ``df`` as given -- call it after the complete-case filter,
    as the reference does.  Returns the coded frame, and with ``keep_mapping``
    also a long mapping table (variable, code, value) for decoding (C8).
    """
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out = df
    maps = []
    for group in by_type.values():
        m = reliable_checkpoint(category_mapping(df, group))
        for c in group:
            lookup = m.where(F.col("variable") == c).select(F.col("value").alias(c), F.col("code").alias(f"_code_{c}"))
            if fits_broadcast(lookup):
                out = out.join(F.broadcast(lookup), c, "left")
            else:  # many categories: shuffle join, with a broadcast branch for categories holding many rows
                out = hot_key_join(out, lookup, [c], "left")
            out = out.withColumn(c + suffix, F.col(f"_code_{c}")).drop(f"_code_{c}")
        maps.append(m.select("variable", "code", F.col("value").cast("string").alias("value")))
    if keep_mapping:
        mapping = maps[0]
        for m in maps[1:]:
            mapping = mapping.unionByName(m)
        return out, mapping
    return out


def decode_categories(df: DataFrame, mapping: DataFrame, cols: Sequence[str], suffix: str = "_label") -> DataFrame:
    """Code -> label through the mapping table (variable, code, value)."""
    out = df
    for c in cols:
        m = mapping.where(F.col("variable") == c).select(F.col("code").alias(c), F.col("value").alias(c + suffix))
        out = join_bounded(out, m, [c], "left")
    return out


def interaction_terms(df: DataFrame, products: dict) -> DataFrame:
    """Add product columns ``name -> (a, b)``; a number in place of a column is a constant proxy."""
    out = df
    for name, (a, b) in products.items():
        ca = F.col(a) if isinstance(a, str) else F.lit(a)
        cb = F.col(b) if isinstance(b, str) else F.lit(b)
        out = out.withColumn(name, ca * cb)
    return out


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value (map-side combined)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop duplicate rows (optionally on a column subset)."""
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()
