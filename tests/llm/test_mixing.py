import collections
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from equipoise.llm import mixing as M

from .helpers import DOCS, odd_documents, words


def targets(sizes, weights=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest, open_weight = budget - sum(2 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and rest * weight[s] / open_weight > 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        full |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 10, None: 5}, {"x": 0, "y": 50},
                                   {None: 7}, {"B": 5, "a": 500, "é": 3, "Z": 40, "b": 1}, {"a": 0}])
def test_targets_are_water_filled(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def documents(n=300, copies=3):
    rows = [(1000 + i, "w " * (1 + i * 7 % 40), "en", "src%d" % (i % 5 if i % 3 else 0), 1, 1.0, "r", "k") for i in range(n)]
    return rows + [rows[0]] * copies + odd_documents()


def test_mix_meets_targets_and_shards_are_disjoint(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS)
    found, placed = M.mix(docs, block_words=200, shard_words=900)
    found, placed = found.toPandas(), placed.toPandas()
    assert len(found) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    want, source = targets(size), {}
    for r in rows:
        source[r[0]] = r[3]
    taken = collections.Counter()
    for r in found.itertuples():
        assert 0 <= r.copies <= 2
        taken[source[None if r.doc_id != r.doc_id else int(r.doc_id)]] += r.size * r.copies
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(25, 0.5 * max(len(words(r[1])) for r in rows if r[3] == s)), (s, taken[s], t)
    assert len(placed) == found.copies.sum() and not placed.duplicated(["row", "pass"]).any()
    assert not placed.duplicated(["shard", "position"]).any() and placed["shard"].nunique() > 5
    again, _ = M.mix(docs, block_words=200, shard_words=900)
    key = ["key", "check", "copies"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, found[key].itertuples(index=False)))


def test_mixed_documents_repeat_rows(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    found = collections.Counter({r.doc_id: r.n for r in M.mix(docs)[0].groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r.n})
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == found


def test_mixed_documents_come_out_as_shards(spark, tmp_path, monkeypatch):
    """The written files, one after the other, are the placements by shard and position; no file has two shards."""
    monkeypatch.setattr(M, "RUN_WORDS", 600, raising=False)
    options = {"block_words": 200, "shard_words": 1800}
    docs = spark.createDataFrame(documents()[:-len(odd_documents())], DOCS).repartition(3)
    want = [(r.shard, r.doc_id) for r in M.mix(docs, **options)[1].orderBy("shard", "position").collect()]
    M.mixed_documents(docs, **options).write.parquet(f"{tmp_path}/mix")
    files = [pq.read_table(f, columns=["doc_id"]).column(0).to_pylist() for f in sorted(glob.glob(f"{tmp_path}/mix/part-*"))]
    assert [i for f in files for i in f] == [i for _, i in want]
    at, shards = 0, len({s for s, _ in want})
    assert shards > 3 and sum(map(bool, files)) == 3 * shards
    for f in files:
        assert len({s for s, _ in want[at:at + len(f)]}) <= 1
        at += len(f)


def test_rows_alike_in_id_source_and_text_are_all_given_out(spark):
    """They may differ elsewhere: each is a document of its own, also where the target is reached among them."""
    rows = [(1, "one two three", f"l{i % 10}", "a", i % 10, 1.0, "r", "k") for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    taken = lambda share: collections.Counter(r.lang for r in M.mixed_documents(docs, total_share=share).collect())
    assert taken(1.0) == {f"l{i}": 2 for i in range(10)}
    assert taken(0.5) == {f"l{i}": 2 for i in range(5)}
    assert taken(1.25) == {f"l{i}": 2 + 2 * (i < 2) + (i == 2) for i in range(10)}
    sources = spark.createDataFrame([(None, "a", "en", None, 1, 1.0, "r", "k"), (None, None, "fr", "a", 1, 1.0, "r", "k")], DOCS)
    assert [(r.text, r.source) for r in M.mixed_documents(sources, total_share=1.0).collect()] == [("a", None)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert M.op10_mixing(spark, str(tmp_path)).count() == 0
    assert M.mixed_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_hypergeometric_quantiles(spark):
    n = 4000
    draws = spark.range(n).select(M.hypergeometric(*(F.lit(x).cast("long") for x in (500, 200, 60)), (F.col("id") + 0.5) / n).alias("k"))
    row = draws.agg(F.avg("k").alias("m"), F.var_pop("k").alias("v")).first()
    assert abs(row.m - 24) < 0.01 and abs(row.v - 60 * 0.4 * 0.6 * 440 / 499) < 0.1
    for args, want in [((10, 10, 4), 4), ((10, 0, 4), 0), ((7, 3, 7), 3), ((0, 0, 0), 0)]:
        assert spark.range(1).select(M.hypergeometric(*(F.lit(x).cast("long") for x in args), F.lit(0.999)).alias("k")).first().k == want


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_quotas_add_up(spark, shards):
    quotas = spark.createDataFrame([(0, 40), (1, 3), (2, 0), (3, 200)], "at long, quota long")
    rows = M.split_quotas(quotas, shards, 1).collect()
    for at, quota in ((0, 40), (1, 3), (3, 200)):
        taken = sorted(x for r in rows if r["at"] == at for x in range(r["first"], r["first"] + r["quota"]))
        assert taken == list(range(quota))
    per = collections.Counter()
    for r in rows:
        per[r["shard"]] += r["quota"]
    assert max(per.values()) - min(per.values()) <= shards
