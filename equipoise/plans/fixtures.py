"""Stand-in inputs built from the driver tables (FIXTURES.md): ``units``, ``coded``, ``scored``.

These only shape rows into the schemas the operators expect; the operators
themselves make no assumption about how the values were produced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with orders: id, treated, outcome, y, dose, acctbal, n_orders, segment, nation, region."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("n_urgent"),
        F.sum(F.when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)).alias("n_high"),
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("n_filled"),
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (c.join(o, c.c_custkey == o.o_custkey)
         .join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    return j.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("n_urgent") >= 3, 1).otherwise(0).alias("treated"),
        F.when(2 * F.col("n_filled") >= F.col("n_orders"), 1).otherwise(0).alias("outcome"),
        (F.col("n_filled").cast("double") / F.col("n_orders").cast("double")).alias("y"),
        (60 * F.col("n_high") + 15 * (F.col("n_orders") % 4)).cast("double").alias("dose"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("n_orders").cast("double").alias("n_orders"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``units`` plus a supplied score ``ps`` (all distinct) and ``ps_tied`` (100 values, forces ties)."""
    u = units(spark, sf_dir)
    return u.withColumn("ps", (F.col("acctbal") + F.lit(1000.0)) / F.lit(11000.0)).withColumn(
        "ps_tied", F.floor((F.col("acctbal") + F.lit(1000.0)) / F.lit(110.0)).cast("double") / F.lit(100.0))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey-style integer codes with special values and NULLs, one row per order."""
    return coded_from_orders(table(spark, sf_dir, "orders"))


ORDERS_SCHEMA = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                 "o_orderdate timestamp, o_orderpriority string")


def coded_from_orders(orders: DataFrame) -> DataFrame:
    """The ``coded`` shape from an orders frame (batch or stream: a stateless projection)."""
    o = orders.select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    cu = F.col("o_custkey")
    return o.select(
        k.alias("id"),
        F.when(k % 5 == 0, 1).when(k % 5 == 1, 2).when(k % 5 == 2, 7).when(k % 5 == 3, 9).alias("yesno"),
        F.when(k % 11 != 0, (1 + cu % 9).cast("int")).alias("scale5"),
        F.when(k % 7 == 0, 888).when(k % 7 == 1, 777).when(k % 7 < 4, 100 + cu % 100)
        .otherwise(200 + cu % 100).alias("freq"),
        F.when(k % 13 != 0, (k * 7 + cu) % 1000).alias("duration"),
        F.when(k % 6 == 0, 88).when(k % 6 == 1, 77).when(k % 6 == 2, 99).otherwise(1 + cu % 40).alias("days30"),
        F.when(k % 17 == 0, 7777).when(k % 17 == 1, 9999).otherwise(90 + cu % 200).alias("weight"),
        F.when(cu % 2 == 0, (1 + k % 4).cast("int")).alias("part_a"),
        F.when(cu % 3 == 0, (1 + k % 3).cast("int")).alias("part_b"),
        F.when(k % 10 == 0, F.lit("")).otherwise((cu % 8).cast("string")).alias("text_num"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")
