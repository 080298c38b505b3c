import math

import numpy as np
import pytest

from equipoise.llm import maxscore as M

VECTORS = "vec_id long, embedding array<float>, label int, score long"


def odd_vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], 1, 2) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8, 1, 2) for i in range(300)]  # very common vector: ties
    rows += [(2001, None, 0, 0), (2002, [1.0, None], 0, 0), (2003, [float("nan")] * 8, 0, 0), (2100, [float("inf")] * 8, 0, 0),
             (None, [1.0] * 8, 0, 0), (2200, [], 0, 0), (2300, [0.9], 0, 0), (2004, [0.0] * 8, 0, 0), (2400, [-0.3] * 8, None, None)]
    rows += [(5, rows[5][1], 1, 2), (100, rows[100][1], 1, 2)]  # repeated rows
    return rows


def expected(rows, k=10):
    use = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, w in {i: w for i, w in sorted(use, reverse=True) if i % 100 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(w, x)), i) for i, x in use if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("shard, block", [(M.SHARD, M.QUERIES), (64, 3)])
def test_top_k_matches_brute_force(spark, tmp_path, shard, block, monkeypatch):
    rows = odd_vectors()
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = spark.read.parquet(f"{tmp_path}/embeddings.parquet").filter(M.usable(M.F.col("embedding")) & M.F.col("vec_id").isNotNull())
    vectors = vectors.select("vec_id", M.weights(M.F.col("embedding")).alias("weights"))
    got = M.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10, shard, block)
    assert set(map(tuple, got.collect())) == expected(rows)
    if shard == M.SHARD:
        assert set(map(tuple, M.op6_maxscore(spark, str(tmp_path)).collect())) == expected(rows)


def test_few_rows_and_empty_table(spark, tmp_path):
    rows = [(0, [1.0, -1.0], 0, 0), (1, [0.5, 0.5], 0, 0)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert [tuple(r) for r in M.op6_maxscore(spark, f"{tmp_path}/a").collect()] == [(0, 1, 1, 0)]
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert M.op6_maxscore(spark, f"{tmp_path}/b").count() == 0


def test_terms_are_left_out_and_rows_pruned():
    rng = np.random.default_rng(1)
    rows = np.zeros((3000, 30), np.int64)
    for d in range(30):  # sparse postings
        rows[rng.choice(3000, 300, replace=False), d] = rng.integers(1, 200, 300)
    shard = M.Shard(np.arange(3000), rows)
    for q in range(20):
        query = rng.integers(0, 100, 30) * (rng.random(30) < 0.3)
        found, scores = shard.top(-1, query, 10)
        want = sorted((-int(s), i) for i, s in enumerate(rows @ query))[:10]
        assert [(-int(s), int(i)) for i, s in zip(found, scores)] == want
