"""Code paths taken beyond the broadcast limit give the same results as the broadcast paths."""

import equipoise.operators.columns as C
import equipoise.operators.joins as J
import equipoise.session as S


def _rows(spark):
    return spark.createDataFrame([(i, f"c{i % 7}", i % 5) for i in range(200)], "id int, cat string, k int")


def test_semijoin_filter_beyond_broadcast_limit(spark, monkeypatch):
    df = _rows(spark)
    values = spark.createDataFrame([(f"c{i}",) for i in range(0, 7, 2)], "v string")
    small = sorted(r.id for r in C.filter_isin(df, "cat", values).collect())
    monkeypatch.setattr(C, "fits_broadcast", lambda small: False)
    large = sorted(r.id for r in C.filter_isin(df, "cat", values).collect())
    assert small == large == [i for i in range(200) if (i % 7) % 2 == 0]


def test_category_codes_beyond_broadcast_limit(spark, monkeypatch):
    df = _rows(spark)
    small = sorted((r.id, r.cat, r.k) for r in C.category_codes(df, ["cat", "k"]).collect())
    monkeypatch.setattr(C, "fits_broadcast", lambda small: False)
    large = sorted((r.id, r.cat, r.k) for r in C.category_codes(df, ["cat", "k"]).collect())
    assert small == large and {c for _, c, _ in small} == set(range(7))


def test_hot_keys_are_salted_beyond_the_limit(spark, monkeypatch):
    big = spark.range(0, 3000).selectExpr("id", "IF(id % 3 = 0, 1, id) AS k")
    small = spark.range(0, 50).selectExpr("id AS k", "id * 2 AS v").unionByName(spark.createDataFrame([(1, 7)], "k long, v long"))
    want = sorted(map(tuple, big.join(small, "k").collect()))
    assert sorted(map(tuple, J.hot_key_join(big, small, ["k"], hot=[(1,)]).collect())) == want
    monkeypatch.setattr(J, "fits_broadcast", lambda small: False)
    assert sorted(map(tuple, J.hot_key_join(big, small, ["k"], hot=[(1,)]).collect())) == want


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    wide = spark.range(0, 100).selectExpr("id", "repeat('x', 1000) AS text")
    assert S.fits_broadcast(wide) and S.fits_broadcast(wide, known_rows=100)
    monkeypatch.setattr(S, "BROADCAST_BYTE_LIMIT", 50_000)
    assert not S.fits_broadcast(wide) and not S.fits_broadcast(wide, known_rows=100)
    assert S.fits_broadcast(wide.select("id")) and not S.fits_broadcast(wide.select("id"), limit=10)
