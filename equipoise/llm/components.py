"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from equipoise.llm.common import materialize

def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node that its links reach.

    ``known`` (node, component) are components that an earlier call found; their links need not be given again.

    A large star hangs a node's larger neighbours on its smallest one, a small star its smaller neighbours and
    itself; the rounds, a logarithm of the nodes in number, end when nothing changes.  Smallest neighbours are
    aggregated before they are shuffled, and a node with very many neighbours is a key that Spark splits in the joins.
    What tells whether a round has changed anything is observed while its links are written.
    """
    if known is not None:
        links = links.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
    edges = materialize(links.filter("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    figures = F.count(F.lit(1)).alias("links"), F.bit_xor(F.xxhash64("u", "v")).alias("mark")
    state = edges.agg(*figures).first().asDict()
    while state["links"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(
            F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        seen = Observation()
        edges = materialize(small.observe(seen, *figures), "links")
        before, state = state, seen.get
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
