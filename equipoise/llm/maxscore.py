"""Exact top-k by inner product with MaxScore, in shards.

A vector's terms are its dimensions, a posting of a term is a row with a weight other than 0.  Vectors are dealt into shards of
about ``SHARD`` rows at most (smaller ones where there would be fewer shards than cores) and queries into blocks of about
``QUERIES``.  A task reads a shard, builds its postings once, and streams a block of queries past it; of q queries over n rows,
q n (1 / SHARD + 1 / QUERIES) vectors are shuffled.  There, for each query:

* a term's bound is the largest product of its weight in the query and any weight in its postings (0 if none is positive);
* the best exact scores of rows that lead the strongest terms' postings give a first threshold;
* terms whose bounds, from the smallest up, add up to less than the threshold are non-essential: a row with postings in these
  alone can't reach it;
* the essential postings are traversed term by term; rows whose sum and the bounds of the rest reach the threshold are
  competitive; for these the non-essential terms are probed, strongest first, while they stay so.

Every shard reports at most k rows a query, and these are merged.  Rows that equal the threshold stay competitive, so ties
are decided by vec_id alone.  Memory: a task holds one shard and one Arrow batch of queries.

Defined results: vectors that are NULL or have a NULL or non-finite component, and rows without a vec_id, take no part.  Shorter
vectors count as filled up with 0.  Rows that repeat a vec_id are candidates each; they are one query, that of the smallest
vector, and none of them is its own candidate.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipoise.llm.common import materialize, ship_package, table

SHARD, LEAST_SHARD, QUERIES, LEADERS = 32_768, 4_096, 32_768, 4


def weights(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as double."""
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vector.isNotNull() & finite


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists, filled up with 0 to the longest."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with one shard and block, queries apart from rows."""
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "block", "query")])
    edges = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
    for start, end in zip([0, *edges], [*edges, batch.num_rows]):
        if end > start:
            yield batch.slice(start, end - start)


class Shard:
    """Postings of one shard's rows, by term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.postings = [np.flatnonzero(rows[:, d]) for d in range(rows.shape[1])]
        self.weights = [rows[p, d] for d, p in enumerate(self.postings)]
        self.high = np.array([max(0, w.max()) if len(w) else 0 for w in self.weights], np.int64)
        self.low = np.array([min(0, w.min()) if len(w) else 0 for w in self.weights], np.int64)

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Shard:
        """The shard of the rows of ``parts`` (ids, weights)."""
        width = max((x.shape[1] for _, x in parts), default=0)
        rows = [np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, x in parts]
        return cls(np.concatenate([i for i, _ in parts] or [np.zeros(0, np.int64)]), np.concatenate(rows or [np.zeros((0, width), np.int64)]))

    def fitted(self, query: np.ndarray) -> np.ndarray:
        """``query`` over the shard's terms: others have no postings, missing ones weigh 0."""
        width = self.rows.shape[1]
        return np.pad(query[:width], (0, max(0, width - len(query))))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows but the query's own, best first."""
        bound = np.maximum(query * self.high, query * self.low)
        strong = np.argsort(-bound, kind="stable")
        threshold = self._leading(query_id, query, strong, k)
        rest = np.cumsum(bound[strong][::-1])[::-1]  # bounds from here on
        essential = int((rest >= threshold).sum()) if threshold is not None else len(strong)
        sums, touched = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        for d in strong[:essential]:
            if query[d]:
                at = self.postings[d]
                if len(at) == len(sums):
                    sums += query[d] * self.weights[d]
                    touched[:] = True
                else:
                    sums[at] += query[d] * self.weights[d]
                    touched[at] = True
        if threshold is None or threshold <= 0:
            touched[:] = True  # rows without a posting score 0
        left = rest[essential] if essential < len(strong) else 0
        rows = np.flatnonzero(touched & (self.ids != query_id) & ((sums + left >= threshold) if threshold is not None else True))
        sums = sums[rows]
        for d in strong[essential:]:
            sums += query[d] * self.rows[rows, d]
            left -= bound[d]
            stay = sums + left >= threshold
            if not stay.all():
                rows, sums = rows[stay], sums[stay]
        best = np.lexsort((self.ids[rows], -sums))[:k]
        return rows[best], sums[best]

    def _leading(self, query_id: int, query: np.ndarray, strong: np.ndarray, k: int) -> int | None:
        """The k-th best score among some rows that lead the strongest postings; None if they are fewer."""
        leaders = []
        for d in strong[:LEADERS]:
            products = query[d] * self.weights[d]
            n = min(len(products), 2 * k + 1)
            if n:
                leaders.append(self.postings[d][np.argpartition(-products, n - 1)[:n]])
        rows = np.unique(np.concatenate(leaders)) if leaders else np.zeros(0, np.int64)
        rows = rows[self.ids[rows] != query_id]
        if len(rows) < k:
            return None
        return int(np.sort(self.rows[rows] @ query)[-k])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` the ``k`` best of ``vectors``; both have (vec_id, weights)."""
    ship_package(vectors.sparkSession)
    # the deal is written, so that a task that runs again finds the same shards
    dealt = materialize(vectors.withColumn("deal", F.xxhash64("vec_id", F.monotonically_increasing_id())), "vectors")
    asked = materialize(queries.groupBy("vec_id").agg(F.min("weights").alias("weights")), "queries")
    n, cores = dealt.count(), vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // shard_rows), min(cores, -(-n // LEAST_SHARD)))
    blocks = max(1, -(-asked.count() // query_rows))
    rows = dealt.select(F.pmod("deal", F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                        F.lit(False).alias("query"), "vec_id", "weights")
    wanted = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                          F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
                          F.lit(True).alias("query"), "vec_id", "weights")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a shard's rows come before the queries for it
        key, held, shard = None, [], None
        for batch in batches:
            for group in _runs(batch):
                own = (group.column("shard")[0].as_py(), group.column("block")[0].as_py())
                if own != key:
                    key, held, shard = own, [], None
                if not group.column("query")[0].as_py():
                    held.append((group.column("vec_id").to_numpy(), matrix(group.column("weights"))))
                    continue
                if shard is None:
                    shard, held = Shard.of(held), []
                ids, queries = group.column("vec_id").to_numpy(), matrix(group.column("weights"))
                out = [(q, *shard.top(q, shard.fitted(query), k)) for q, query in zip(ids, queries)]
                yield pa.record_batch({
                    "query_id": np.repeat(ids, [len(r) for _, r, _ in out]).astype(np.int64),
                    "vec_id": np.concatenate([shard.ids[r] for _, r, _ in out]).astype(np.int64),
                    "score": np.concatenate([x for _, _, x in out]).astype(np.int64)})

    placed = rows.unionByName(wanted).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "query")
    found = placed.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # k rows a shard
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows by inner product for every row whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", weights(F.col("embedding")).alias("weights"))
    return top_k(rows, rows.filter(F.col("vec_id") % 100 == 0), 10)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.w, b.w)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 10
"""
