"""Caliper matching equals brute force (all pairs + sort) on random frames with ties and edge cases."""

import random

import pytest

from equipoise.operators.matching import match_nearest, matched_cohort, matched_sides


def brute(rows, caliper, k):
    treated = [(i, s) for i, t, s in rows if t == 1 and s is not None]
    controls = [(i, s) for i, t, s in rows if t == 0 and s is not None]
    out = set()
    for ti, ts in treated:
        cands = sorted((abs(cs - ts), ci, cs) for ci, cs in controls if abs(cs - ts) <= caliper)
        for d, ci, cs in cands[:k]:
            out.add((ti, ci, ts, cs, d))
    return out


def run(spark, rows, caliper, k):
    df = spark.createDataFrame(rows, "id long, treated int, ps double")
    got = match_nearest(df, "ps", "treated", "id", caliper, k).collect()
    return {(r.treated_id, r.control_id, r.ps_treated, r.ps_control, r.distance) for r in got}


@pytest.mark.parametrize("seed,k,caliper,levels", [
    (1, 1, 0.05, None), (2, 2, 0.05, 20), (3, 3, 0.02, 7), (4, 1, 0.001, None), (5, 2, 1.0, 5),
])
def test_matches_brute_force(spark, seed, k, caliper, levels):
    rnd = random.Random(seed)
    rows = []
    for i in range(300):
        s = rnd.random() if levels is None else rnd.randrange(levels) / levels
        rows.append((i, 1 if rnd.random() < 0.35 else 0, s))
    assert run(spark, rows, caliper, k) == brute(rows, caliper, k)


def test_hot_score_third_of_rows(spark):
    """One score value holds a third of all rows (both arms): still exact, ties by control id."""
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        s = 0.5 if i % 3 == 0 else round(rnd.random(), 3)
        rows.append((i, i % 2, s))
    for k in (1, 2):
        assert run(spark, rows, 0.05, k) == brute(rows, 0.05, k)


def test_empty_control_and_k_above_controls(spark):
    rows = [(1, 1, 0.2), (2, 1, 0.4)]
    assert run(spark, rows, 0.5, 1) == set()
    rows = [(1, 1, 0.2), (2, 0, 0.25), (3, 0, 0.1), (4, 1, None), (5, 0, None)]
    assert run(spark, rows, 0.5, 5) == brute(rows, 0.5, 5)


def test_ties_left_and_right_and_exact_scores(spark):
    # control 10 and 11 are equally far below/above the treated score; the smaller id wins
    rows = [(1, 1, 0.5), (11, 0, 0.4), (10, 0, 0.6), (12, 0, 0.0), (13, 0, 1.0), (2, 1, 1.0), (3, 1, 0.0)]
    assert run(spark, rows, 0.2, 1) == brute(rows, 0.2, 1)
    assert {(r[0], r[1]) for r in run(spark, rows, 0.2, 1)} >= {(1, 10)}


def test_cohort_and_sides(spark):
    rows = [(1, 1, 0.5), (2, 1, 0.52), (3, 0, 0.51), (4, 0, 0.9)]
    df = spark.createDataFrame(rows, "id long, treated int, ps double")
    pairs = match_nearest(df, "ps", "treated", "id", 0.05, 1)
    cohort = sorted(r.id for r in matched_cohort(df, pairs, "id").collect())
    assert cohort == [1, 2, 3]  # control 3 reused but kept once (Q12)
    sides = sorted(r.id for r in matched_sides(df, pairs, "id", "treated").collect())
    assert sides == [1, 2, 3]


def test_grid_settings_match_brute_force_with_hot_keys(spark):
    """Several settings in one pass; thresholds low enough that the hot-key branch is taken."""
    from equipoise.operators.matching import match_grid

    rnd = random.Random(11)
    rows = [(i, 1 if i % 3 else 0, 0.4 if i % 4 == 0 else round(rnd.random(), 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, treated int, ps double")
    grid = [(0.05, 1), (0.1, 1), (0.1, 2), (0.15, 1)]
    got = match_grid(df, "ps", "treated", "id", grid, hot_share=0.01, hot_min_rows=5).collect()
    for i, (cal, k) in enumerate(grid):
        mine = {(r.treated_id, r.control_id, r.ps_treated, r.ps_control, r.distance) for r in got if r.setting == i}
        assert mine == brute(rows, cal, k)


def test_hot_key_join_equals_plain_join(spark):
    from equipoise.operators.joins import hot_key_join, hot_keys

    big = spark.createDataFrame([(i % 50 if i % 3 else 7, i) for i in range(3000)], "k int, v int")
    small = spark.createDataFrame([(k, f"s{k}") for k in range(0, 60, 2)] + [(None, "n")], "k int, s string")
    assert hot_keys(big, ["k"], share=0.1, min_rows=10) == [(7,)]
    for how in ("inner", "left"):
        a = sorted(map(tuple, hot_key_join(big, small, ["k"], how, share=0.1, min_rows=10).collect()),
                   key=repr)
        b = sorted(map(tuple, big.join(small, ["k"], how).collect()), key=repr)
        assert a == b
