"""A1/A3/A4/A5: read tables, write results, assign row ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from equipoise.functions.recode import blank_as_null, nan_as_null
from equipoise.operators.ranking import cumulative_sum, row_index
from equipoise.session import join_small, reliable_checkpoint


def clean_values(df: DataFrame) -> DataFrame:
    """Q1/Q3 at a stage border: NaN and blank text become NULL, as a pass through a delimited file makes them.

    One projection over the float and string columns; the others, and the column order, stay.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    new = {c: nan_as_null(F.col(f"`{c}`")) for c, k in kinds.items() if k in ("double", "float")}
    new |= {c: blank_as_null(F.col(f"`{c}`")) for c, k in kinds.items() if k == "string"}
    return df.withColumns(new) if new else df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None,
               columns=None, encoding: str | None = None, fallback_encoding: str | None = None) -> DataFrame:
    """A1/A3: read a delimited file (header row) or any Spark source; blank text and NaN become NULL.

    Give ``schema`` in production: inference costs an extra pass over the data.
    ``columns`` prunes to the wanted columns that exist (B1), pushed into the scan.
    ``encoding`` is the character set of a delimited file, Spark's default (UTF-8) unless given.  With
    ``fallback_encoding`` a file with a line that isn't valid in the first one is read in the second.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        if fallback_encoding and not _decodes(spark, path, encoding or "UTF-8"):
            encoding = fallback_encoding
        if encoding:
            reader = reader.option("encoding", encoding)
        df = reader.option("header", True).option("inferSchema", schema is None).csv(path)
    else:
        df = reader.format(fmt).load(path)
    if columns is not None:
        have = set(df.columns)
        df = df.select(*[c for c in columns if c in have])
    return clean_values(df)


def _decodes(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether the files at ``path`` are valid in ``encoding``: what a line decodes to has the line's bytes.

    Reading stops at the first part of the files that isn't.  A valid file may hold the replacement character itself.
    """
    if encoding.upper().replace("_", "-") in ("UTF-8", "UTF8"):
        # the reader hands on a line's bytes as they are
        return spark.read.text(path).where(~F.is_valid_utf8(F.col("value"))).isEmpty()
    lines = spark.read.option("encoding", encoding).csv(path, sep="\u0001", quote="", schema="line string")
    return lines.where(F.col("line").contains("\ufffd")).isEmpty()


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A4: write a result table (CSV with a header row, no index column; or Parquet)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def with_row_id(df: DataFrame, id_col: str, order_by) -> DataFrame:
    """A5: add ``id_col`` = 0..n-1 in ``order_by`` order when the table has no id column yet."""
    if id_col in df.columns:
        return df
    return row_index(df, order_by, out=id_col)


def read_in_file_order(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """A5: a Parquet table with ``id_col`` = 0..n-1 in the order of its files (by name) and of the rows in each.

    The reader tells each row's file and place; the rows of the files before are one offset a file, so no row is sorted or
    shuffled.  A table that has the column keeps it.
    """
    df = spark.read.parquet(path)
    if id_col in df.columns:
        return df
    file, at, first = "_eq_file", "_eq_at", "_eq_first"
    rows = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    counts = reliable_checkpoint(rows.groupBy(file).agg(F.count(F.lit(1)).alias("n")))
    offsets = cumulative_sum(counts, "n", [file], out=first).select(file, first)
    placed = join_small(rows, reliable_checkpoint(offsets), file)
    return placed.withColumn(id_col, F.col(first) + F.col(at)).select(*df.columns, id_col)


def with_unordered_id(df: DataFrame, id_col: str) -> DataFrame:
    """A5 when order does not matter: unique (not consecutive) ids with no shuffle."""
    if id_col in df.columns:
        return df
    return df.withColumn(id_col, F.monotonically_increasing_id())
