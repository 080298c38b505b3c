"""Recode rules and the semantics table on tiny frames."""

from pyspark.sql import functions as F

from equipoise.functions import recode as R
from equipoise.functions import rowwise as W
from equipoise.operators.columns import category_codes, complete_cases, decode_categories
from equipoise.operators.scaling import minmax_scale_spec, standardize


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("v")).collect()]


def test_missing_is_not_positive_and_not_good(spark):  # Q1
    vals = one(spark, [(None,), (0.0,), (2.0,)], "x double", R.any_positive(["x"]))
    assert vals == [0, 0, 1]
    assert one(spark, [(None,), (0.5,), (0.6,)], "x double", R.threshold_flag("x", 0.5)) == [0, 1, 0]


def test_nan_becomes_null(spark):
    vals = one(spark, [(float("nan"),), (1.0,)], "x double", R.nan_as_null("x"))
    assert vals == [None, 1.0]


def test_unlisted_codes_are_null(spark):  # Q4
    m = {1: 1, 2: 0, 7: None, 9: None, "BLANK": None, None: None}
    assert one(spark, [(1,), (2,), (7,), (5,), (None,)], "x int", R.recode("x", m)) == [1, 0, None, None, None]


def test_indicator_sends_special_codes_to_zero(spark):  # Q5
    assert one(spark, [(1,), (7,), (None,)], "x int", R.indicator("x")) == [1, 0, 0]
    assert one(spark, [(1,), (2,), (None,)], "x int", R.flag_index(["x", "x"], denominator=6))[0] == 2 / 6


def test_row_sum_and_mean_all_null(spark):  # Q6
    rows = [(None, None), (1.0, None), (1.0, 3.0)]
    assert one(spark, rows, "a double, b double", W.row_sum(["a", "b"])) == [0.0, 1.0, 4.0]
    assert one(spark, rows, "a double, b double", W.row_mean(["a", "b"])) == [None, 1.0, 2.0]


def test_weighted_mean_renormalises(spark):
    rows = [(None, None), (1.0, None), (1.0, 0.0)]
    got = one(spark, rows, "a double, b double", W.weighted_mean({"a": 0.4, "b": 0.6}))
    assert got[0] is None and got[1] == 1.0 and abs(got[2] - 0.4) < 1e-15


def test_frequency_and_minutes(spark):  # Q7, Q8
    rows = [(105,), (212,), (888,), (300,), (None,)]
    got = one(spark, rows, "x int", R.weekly_rate("x", 4.345, never_code=888))
    assert got[0] == 5.0 and abs(got[1] - 12 / 4.345) < 1e-15 and got[2] == 0.0 and got[3] is None and got[4] is None
    assert one(spark, [(45,), (759,), (830,), (760,)], "x int", R.minutes("x")) == [45.0, 759.0, 1800.0, None]


def test_day_scale_and_zero_fill(spark):
    rows = [(88,), (15,), (31,), (None,)]
    assert one(spark, rows, "x int", R.day_scale("x")) == [None, 0.5, None, None]
    assert one(spark, rows, "x int", R.in_range_or_zero("x", 1, 30, 30.0)) == [0.0, 0.5, 0.0, 0.0]


def test_first_non_null_score_and_member(spark):
    rows = [(None, 3), (1, 3), (None, None), (2, 1)]
    assert one(spark, rows, "a int, b int", R.first_non_null_score("a", "b", {1: 1, 3: 0.5})) == [0.5, 1.0, 0.0, 0.0]
    assert one(spark, [(2.0,), (3.0,), (None,)], "x double", R.member_flag("x", [1, 2, 4, 5, 7])) == [True, False, False]


def test_fixed_bins_right_closed_zero_outside(spark):  # Q10
    got = one(spark, [(0.0,), (0.3,), (0.31,), (1.0,), (1.2,)], "x double",
              R.fixed_bins("x", [0, 0.3, 0.6, 1.0], ["Poor", "Fair", "Good"]))
    assert got == [None, "Poor", "Fair", "Good", None]


def test_clean_name_and_strip_html(spark):
    assert one(spark, [("Adverse Childhood Experiences (ACE)",)], "s string", R.clean_name("s")) == [
        "adverse_childhood_experiences"]
    assert one(spark, [("<b>Yes&nbsp;&amp; no</b> ",)], "s string", R.strip_html("s")) == ["Yes & no"]


def test_category_codes_after_filter_and_decode(spark):  # hard part 3
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "id int, cat string")
    coded, mapping = category_codes(complete_cases(df), ["cat"], keep_mapping=True)
    got = {r.id: r.cat for r in coded.collect()}
    assert got == {1: 1, 2: 0, 4: 2}
    back = {r.id: r.cat_label for r in decode_categories(coded, mapping, ["cat"]).collect()}
    assert back == {1: "b", 2: "a", 4: "c"}


def test_scaling_modes_and_zero_sd(spark):  # Q16, hard part 7
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    out = minmax_scale_spec(df, {"a": ("a_n", "null"), "b": ("b_n", "zero")}).collect()
    assert [r.a_n for r in out] == [0.0, 1.0, None] and [r.b_n for r in out] == [0.0, 0.0, 0.0]
    z = standardize(df, ["a", "b"], suffix="_z").collect()
    assert [r.a_z for r in z][:2] == [-1.0, 1.0] and [r.b_z for r in z] == [0.0, 0.0, 0.0]


def test_try_cast_coercion(spark):
    assert one(spark, [("3",), ("",), ("x",)], "s string", R.to_number("s")) == [3.0, None, None]
    assert F is not None
