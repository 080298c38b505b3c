"""Registered queries: one per operator of SURVEY 2, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through the fixtures) and runs the
library's own operators over the whole tables.  Floating results of
aggregates are rounded to 6 places so that they compare with the SQL oracle
independent of summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipoise.functions import recode as R
from equipoise.functions import rowwise as W
from equipoise.functions.text import strip_html_full
from equipoise.operators import balance as B
from equipoise.operators import effects as E
from equipoise.operators import propensity as P
from equipoise.operators.bins import equal_width_bins, histogram, width_bins
from equipoise.operators.columns import (
    category_codes, complete_cases, decode_categories, distinct_rows, drop_available, filter_isin,
    interaction_terms, select_available, value_counts)
from equipoise.operators.matching import match_nearest, matched_cohort, reuse_weights
from equipoise.operators.ranking import describe, row_index
from equipoise.operators.scaling import minmax_scale, standardize
from equipoise.plans import fixtures as fx
from equipoise.plans import specs as SP
from equipoise.plans.matching import MatchingAnalysis, define_survey_variables, prepare
from equipoise.plans.preprocess import (
    CODED_RAW, CODED_SCALE5, CODED_WEIGHTS, CODED_YESNO, coded_preprocess, coded_recodes, survey_preprocess)
from equipoise.plans.survey_config import LABEL_MAPS, SPEC_GRID, TARGET_VARIABLES
from equipoise.plans.survey_oracle import LABELLED, NUMERIC, survey_rows
from equipoise.plans.weighting import WeightingAnalysis, dose_measures
from equipoise.session import ensure_checkpoint_dir, join_small, reliable_checkpoint, scratch_path
from equipoise.sources import codebook as CB
from equipoise.sources.io import clean_values, read_in_file_order, read_table, write_result
from equipoise.sources.report import spec_report_document, spec_report_lines
from equipoise.streaming.recode_stream import preprocess_stream

COVS = ["acctbal", "n_orders", "dose", "ps_tied"]
CALIPER = 0.05
UNIT_CONFOUNDERS = ["acctbal", "n_orders", "dose", "segment", "nation"]
UNIT_CATEGORICAL = ["segment", "nation"]
SUBGROUPS = {"Segment": "segment", "Nation": "nation", "Region": "region"}
UNITS_SCHEMA = ("id long, treated int, outcome int, y double, dose double, acctbal double, n_orders double, "
                "segment string, nation string, region string")


def _round(df: DataFrame, cols, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


# ---- fixtures ---------------------------------------------------------------------------

def _scored(spark, d):
    return fx.scored(spark, d)


def _coded_recoded(spark, d) -> DataFrame:
    c = fx.coded(spark, d)
    return c.withColumns({
        "yesno_score": R.recode("yesno", CODED_YESNO),
        "scale5_score": R.recode("scale5", CODED_SCALE5),
        "freq_weekly": R.weekly_rate("freq", 4.345, never_code=888),
        "duration_min": R.minutes("duration"),
        "days30_mapped": R.day_scale("days30", (77, 88, 99), 30),
    })


def _pairs(spark, d, score="ps", caliper=CALIPER, ratio=1):
    return match_nearest(_scored(spark, d), score, "treated", "id", caliper, ratio)


def _cohort(spark, d):
    s = _scored(spark, d)
    return matched_cohort(s, match_nearest(s, "ps", "treated", "id", CALIPER, 1), "id")


def _weighted(spark, d):
    return E.ipw_weights(_scored(spark, d), "ps", "treated")


def _dose_bins(spark, d):
    w = _weighted(spark, d)
    binned = width_bins(w, "dose", 60.0, out="dose_bin")
    return E.weighted_bin_stats(binned, "dose_bin", "y", "ipw_weight", extra_keys=["dose_bin_start"])


# ---- 2.A sources and sinks -------------------------------------------------------------

def q_scan_units(spark, d):
    return fx.units(spark, d)


def q_sink_roundtrip(spark, d):
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "roundtrip")
    write_result(fx.units(spark, d), path, "csv")
    return read_table(spark, path, "csv", schema=UNITS_SCHEMA)


def q_nan_ingest(spark, d):
    """Q1: NaN in an input counts as missing in flags, sums, means and scaling."""
    u = fx.units(spark, d).select("id", "n_orders", F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("dose")).alias("dose"))
    u = clean_values(u).withColumns({"flag": R.any_positive(["dose"]), "total": W.row_sum(["dose", "n_orders"]),
                                     "average": W.row_mean(["dose", "n_orders"])})
    return _round(minmax_scale(u, ["dose"]), ["average", "dose_NORMALIZED"])


def q_blank_border(spark, d):
    """Q3: rows with a blank label leave a cohort alike whether the table is handed on in memory or as a file."""
    c = fx.coded(spark, d)
    label = F.when(F.col("scale5") == 3, F.lit("")).otherwise(F.concat(F.lit("level "), F.col("scale5").cast("string")))
    c = c.select("id", label.alias("label"))
    path = scratch_path(spark, "border")
    write_result(c, path, "csv")
    memory = complete_cases(clean_values(c)).withColumn("route", F.lit("memory"))
    file = complete_cases(read_table(spark, path, "csv", schema="id long, label string")).withColumn("route", F.lit("file"))
    return memory.unionByName(file)


def q_row_id(spark, d):
    return row_index(fx.coded(spark, d).select("id", "yesno"), ["id"], out="row_id")


def q_codebook_entries(spark, d):
    return CB.link_entries(fx.pages(spark, d))


def q_codebook_values(spark, d):
    return CB.nested_entries(fx.pages(spark, d))


def q_spec_report(spark, d):
    return spec_report_lines(q_spec_comparison(spark, d))


# ---- 2.B projections, filters, recodes --------------------------------------------------

def q_select_available(spark, d):
    return select_available(fx.units(spark, d), ["id", "treated", "acctbal", "not_a_column", "segment"])


def q_drop_available(spark, d):
    return drop_available(fx.units(spark, d), ["dose", "y", "missing_column"])


def q_filter_isin(spark, d):
    return filter_isin(fx.units(spark, d), "segment", ["BUILDING", "MACHINERY"])


def q_filter_semijoin(spark, d):
    u = fx.units(spark, d)
    wanted = u.where(F.col("treated") == 1).select("nation")
    return filter_isin(u, "nation", wanted).select("id", "nation", "treated")


def q_filter_semijoin_regions(spark, d):
    """B3 against a table of values that leaves most rows out."""
    n, r = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    asian = n.join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey).select("n_name")
    return filter_isin(fx.units(spark, d), "nation", asian).select("id", "nation", "treated")


def q_complete_cases(spark, d):
    return complete_cases(fx.coded(spark, d), ["yesno", "scale5", "duration"])


def q_treatment_flag(spark, d):
    c = fx.coded(spark, d)
    flag = R.any_positive([R.weekly_rate("freq", 4.345, never_code=888), F.col("part_a") - 2, F.col("part_b") - 2])
    return c.select("id", flag.alias("treated_flag"))


def q_outcome_flag(spark, d):
    c = fx.coded(spark, d)
    return c.select("id", R.threshold_flag(R.day_scale("days30"), 0.5).alias("outcome_flag"))


def q_recode_scores(spark, d):
    return _coded_recoded(spark, d).select("id", "yesno_score", "scale5_score")


def q_recode_labels(spark, d):
    c = fx.coded(spark, d)
    return c.select("id", R.recode("scale5", LABEL_MAPS["MARITAL"]).alias("scale5_label"))


def q_recode_lookup(spark, d):
    c = fx.coded(spark, d)
    lookup = spark.createDataFrame([(k, float(v)) for k, v in CODED_SCALE5.items() if v is not None],
                                   "scale5 int, scale5_value double")
    return join_small(c.select("id", "scale5"), lookup, "scale5", "left").select("id", "scale5", "scale5_value")


def q_null_special_codes(spark, d):
    return fx.coded(spark, d).select("id", R.null_codes("weight", [7777, 9999]).alias("weight_clean"))


def q_flag_index(spark, d):
    c = fx.coded(spark, d)
    cols = ["yesno", "part_a", "part_b"]
    return c.select("id", sum((R.indicator(x) for x in cols), F.lit(0)).alias("flag_count"),
                    R.flag_index(cols).alias("flag_index"))


def q_frequency_code(spark, d):
    return _coded_recoded(spark, d).select("id", "freq", "freq_weekly")


def q_duration_code(spark, d):
    return _coded_recoded(spark, d).select("id", "duration", "duration_min")


def q_bounded_scale(spark, d):
    c = fx.coded(spark, d)
    return c.select("id", R.day_scale("days30").alias("days30_mapped"),
                    R.in_range_or_zero("days30", 1, 30, 30.0).alias("days30_or_zero"))


def q_coalesce_score(spark, d):
    c = fx.coded(spark, d)
    return c.select("id", R.first_non_null_score("part_a", "part_b", {1: 1, 3: 0.5}).alias("pair_score"))


def q_category_codes(spark, d):
    u = fx.units(spark, d).select("id", "segment", "nation")
    return category_codes(complete_cases(u), ["segment", "nation"], suffix="_code")


def q_category_codes_missing(spark, d):
    """B15 with missing categories, which stay missing."""
    u = fx.units(spark, d).select("id", F.nullif(F.col("segment"), F.lit("BUILDING")).alias("segment"))
    return category_codes(u, ["segment"], suffix="_code")


def q_coerce_numeric(spark, d):
    return fx.coded(spark, d).select("id", "text_num", R.to_number("text_num").alias("text_value"))


def q_bin_fixed(spark, d):
    c = _coded_recoded(spark, d)
    freq = F.least(W.row_sum(["freq_weekly", "part_a"]), F.lit(7.0))
    return c.select("id", R.fixed_bins(freq, [-1, 0, 2, 4, 7], ["None", "Low", "Moderate", "High"])
                    .alias("activity_category"),
                    R.fixed_bins("days30_mapped", [0, 0.3, 0.6, 1.0], ["Poor", "Fair", "Good"])
                    .alias("days_category"))


def q_bin_width(spark, d):
    return width_bins(fx.units(spark, d).select("id", "dose"), "dose", 60.0, out="dose_bin")


def q_bin_equal_width(spark, d):
    return equal_width_bins(fx.units(spark, d).select("id", "y"), "y", ["Poor", "Fair", "Good"], "y_band")


def q_dose_measures(spark, d):
    c = _coded_recoded(spark, d).withColumn("weight_min", R.minutes("weight"))
    out = dose_measures(c, ["freq_weekly", "part_a", "part_b"], ["duration_min", "weight_min"], prefix="EX")
    return out.select("id", "TOTAL_EX_DAYS", "TOTAL_EX_MINUTES", "EX_FREQUENCY", "EX_INTENSITY_PER_SESSION",
                      "EX_VOLUME", "EX_CATEGORY")


def q_interaction_terms(spark, d):
    coded = category_codes(fx.units(spark, d).select("id", "acctbal", "segment", "nation"),
                           ["segment", "nation"], suffix="_code")
    out = interaction_terms(coded, {"segment_nation": ("segment_code", "nation_code"),
                                    "acctbal_segment": ("acctbal", "segment_code"),
                                    "segment_age_proxy": ("segment_code", 50)})
    return out.select("id", "segment_nation", "acctbal_segment", "segment_age_proxy")


def q_member_flag(spark, d):
    return fx.coded(spark, d).select("id", R.member_flag("scale5", [1, 2, 4, 5, 7]).alias("scale5_member"))


def q_bin_midpoint(spark, d):
    b = _dose_bins(spark, d)
    parts = F.split(F.col("dose_bin"), "-")
    mid = (parts.getItem(0).try_cast("double") + parts.getItem(1).try_cast("double")) / 2
    out = b.select("dose_bin", mid.alias("bin_midpoint"), "mean").where(F.col("bin_midpoint").between(30, 500))
    return _round(out, ["mean"])


def q_min_group_size(spark, d):
    return value_counts(fx.units(spark, d), "nation").where(F.col("count") >= 50)


# ---- 2.C joins --------------------------------------------------------------------------

def q_join_left_labels(spark, d):
    p = fx.pages(spark, d).select("page_id", "url")
    return p.join(CB.nested_entries(fx.pages(spark, d)), "page_id", "left")


def q_join_left_labels_unmatched(spark, d):
    """C1 where pages have no label rows: each page comes a second time under an id that no label has, and stays without labels."""
    p = fx.pages(spark, d).select("page_id", "url")
    p = p.unionByName(p.withColumn("page_id", -1 - F.col("page_id")))
    return p.join(CB.nested_entries(fx.pages(spark, d)), "page_id", "left")


def q_join_left_scores(spark, d):
    """Every customer with the score of its unit; customers without orders have none."""
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return c.join(_scored(spark, d).select("id", "treated", "ps"), "id", "left")


def q_balance_compare(spark, d):
    before = B.balance(_scored(spark, d), COVS, "treated")
    after = B.balance(_cohort(spark, d), COVS, "treated")
    return _round(B.balance_compare(before, after), ["abs_smd_before", "abs_smd_after", "improvement"])


def q_matched_cohort(spark, d):
    return _cohort(spark, d).select("id", "treated", "outcome", "ps")


def q_match_nearest(spark, d):
    return _pairs(spark, d, "ps", CALIPER, 1)


def q_match_nearest_tight(spark, d):
    return _pairs(spark, d, "ps", 0.0005, 1)


def q_match_knn(spark, d):
    return _pairs(spark, d, "ps_tied", CALIPER, 2)


def q_decode_categories(spark, d):
    u = complete_cases(fx.units(spark, d).select("id", "segment"))
    coded, mapping = category_codes(u.withColumnRenamed("segment", "segment_code"), ["segment_code"],
                                    keep_mapping=True)
    return decode_categories(coded, mapping, ["segment_code"], suffix="_label").select(
        "id", "segment_code", F.col("segment_code_label").alias("segment_label"))


# ---- 2.D aggregations -------------------------------------------------------------------

def q_balance_before(spark, d):
    return _round(B.balance(_scored(spark, d), COVS, "treated"), ["treated_mean", "control_mean", "smd"])


def q_balance_after(spark, d):
    return _round(B.balance(_cohort(spark, d), COVS, "treated"), ["treated_mean", "control_mean", "smd"])


def q_balance_summary(spark, d):
    b = B.balance_summary(B.balance(_scored(spark, d), COVS, "treated")).withColumn("stage", F.lit("before"))
    a = B.balance_summary(B.balance(_cohort(spark, d), COVS, "treated")).withColumn("stage", F.lit("after"))
    return _round(b.unionByName(a), ["mean_abs_smd", "max_abs_smd"])


def q_treatment_effect(spark, d):
    return _round(E.treatment_effect(_cohort(spark, d), "outcome", "treated"), ["value"])


def q_value_counts(spark, d):
    return value_counts(fx.units(spark, d), "segment")


def q_minmax_scale(spark, d):
    return minmax_scale(fx.units(spark, d).select("id", "acctbal", "n_orders", "dose"),
                        ["acctbal", "n_orders", "dose"]).select(
        "id", "acctbal_NORMALIZED", "n_orders_NORMALIZED", "dose_NORMALIZED")


def q_row_sum(spark, d):
    c = _coded_recoded(spark, d)
    return c.select("id", W.row_sum(["yesno_score", "scale5_score", "days30_mapped"]).alias("row_total"))


def q_row_mean(spark, d):
    c = _coded_recoded(spark, d)
    return c.select("id", W.row_mean(["yesno_score", "scale5_score", "days30_mapped"]).alias("row_avg"))


def q_severity_score(spark, d):
    c = fx.coded(spark, d)
    sev = W.row_mean([W.frequency_part("freq", 4.3, 30), W.scaled_part("scale5", 1, 76, 15),
                      W.scaled_part("days30", 1, 76, 30), W.scaled_part("weight", 1, 76, 15)])
    return c.select("id", sev.alias("severity"))


def q_weighted_index(spark, d):
    c = _coded_recoded(spark, d)
    return c.select("id", W.weighted_mean(CODED_WEIGHTS).alias("combo_index"))


def q_dose_response_bins(spark, d):
    return _round(_dose_bins(spark, d), ["mean", "se", "ci_lower", "ci_upper"])


def _wls_round(df):
    return _round(df.drop("p_value"), ["coef", "se", "t_stat", "r_squared"])


def q_wls_dose(spark, d):
    return _wls_round(E.wls(_weighted(spark, d), "y", "dose", "ipw_weight"))


def q_wls_offset(spark, d):
    """D10 on a predictor with a large offset: the slope doesn't lose its digits."""
    far = _weighted(spark, d).withColumn("dose_far", F.col("dose") + F.lit(1e8))
    out = E.wls(far, "y", "dose_far", "ipw_weight").where("term = 'dose_far'").drop("t_stat", "p_value")
    return _round(_round(out, ["coef", "se"], 4), ["r_squared"])


def _subgroup_frame(spark, d):
    w = _weighted(spark, d)
    return equal_width_bins(w, "y", ["Poor", "Fair", "Good"], "baseline")


def _subgroup_tests(spark, d):
    groups = dict(SUBGROUPS, **{"Outcome Baseline": "baseline"})
    return E.subgroup_effects(_subgroup_frame(spark, d), "y", "treated", "ipw_weight", groups, 50)


def q_subgroup_effects(spark, d):
    return _round(_subgroup_tests(spark, d).select("subgroup", "category", "effect", "sample_size"), ["effect"])


def q_subgroup_pvalues(spark, d):
    """D11 with D10's errors and p-values, from the same moments."""
    return _round(_subgroup_tests(spark, d), ["effect", "se", "t_stat", "p_value"])


def q_auc(spark, d):
    return _round(P.auc(_scored(spark, d), "ps_tied", "treated"), ["auc"])


def q_describe(spark, d):
    return _round(describe(fx.units(spark, d), ["acctbal", "n_orders", "dose", "y"]),
                  ["mean", "std", "min", "q25", "q50", "q75", "max"])


def q_histogram(spark, d):
    return histogram(_scored(spark, d), "ps", 30, group="treated")


def q_distinct_rows(spark, d):
    return distinct_rows(CB.nested_entries(fx.pages(spark, d)).select("value", "value_label"))


def q_sample_sizes(spark, d):
    return B.sample_sizes({"before": _scored(spark, d), "after": _cohort(spark, d)}, "treated")


def q_balance_improvement(spark, d):
    before = B.balance(_scored(spark, d), COVS, "treated")
    after = B.balance(_cohort(spark, d), COVS, "treated")
    return _round(B.balance_improvement(before, after), ["overall_before", "overall_after", "improvement"])


# ---- 2.F / 2.G / 2.J results ------------------------------------------------------------

def q_top_covariates(spark, d):
    return _round(B.top_imbalanced(B.balance(_scored(spark, d), COVS, "treated"), 10),
                  ["treated_mean", "control_mean", "smd", "abs_smd"])


def q_top_covariates_many(spark, d):
    """F2 over more than ten covariates, and F1: the position of each in the order."""
    s = _scored(spark, d).withColumns({f"cov_{k:02d}": F.col("id") % (k + 3) for k in range(14)})
    top = B.top_imbalanced(B.balance(s, [f"cov_{k:02d}" for k in range(14)], "treated"), 10)
    # the ten rows in the order in which they come out
    listed = top.agg(F.collect_list(F.struct("variable", "smd")).alias("rows")).select(F.posexplode("rows").alias("position", "row"))
    return _round(listed.select("position", "row.variable", "row.smd"), ["smd"])


def q_spec_comparison(spark, d):
    res = SP.spec_comparison_with_scores(spark, _scored(spark, d), {"ps": "ps", "ps_tied": "ps_tied"},
                                         ["acctbal", "n_orders", "dose"], "id", "treated", "outcome", SPEC_GRID)
    return _round(res, ["auc", "avg_abs_std_diff", "treatment_effect"])


def q_spec_balance(spark, d):
    """The balance of each covariate in every specification and setting."""
    confounders = {"ps": ["acctbal", "n_orders", "dose"], "ps_tied": ["acctbal", "dose"]}
    test = SP.spec_test_with_scores(_scored(spark, d), {"ps": "ps", "ps_tied": "ps_tied"}, confounders, "id", "treated", "outcome", SPEC_GRID)
    return _round(test.balance, ["treated_mean", "control_mean", "smd"])


def q_spec_labels(spark, d):
    """L4: the results under the names of a comparison chart's series."""
    return SP.with_config_label(q_spec_comparison(spark, d)).select("label", "n_matches", "avg_abs_std_diff", "treatment_effect")


def q_spec_report_document(spark, d):
    return spec_report_document(q_spec_comparison(spark, d))


def q_best_spec(spark, d):
    return SP.best_spec(q_spec_comparison(spark, d))


def q_dose_curve_top20(spark, d):
    b = _dose_bins(spark, d).where(F.col("count") > 10).orderBy("dose_bin_start").limit(20)
    return _round(b, ["mean", "se", "ci_lower", "ci_upper"])


def q_clean_name(spark, d):
    p = fx.pages(spark, d)
    title = F.regexp_extract(F.col("html"), r"<title>(.*?)</title>", 1)
    return p.select("page_id", title.alias("title")).select("page_id", "title", R.clean_name("title").alias("clean"))


def q_strip_html(spark, d):
    blocks = CB.extract_groups(fx.pages(spark, d), "html", CB.LIST_ITEM_PATTERN, ["block"], keep=["page_id"],
                               position="block_no")
    return blocks.select("page_id", "block_no", R.strip_html("block").alias("text"))


def q_footer_text(spark, d):
    """H2 with the full entity table over every page's footer."""
    p = fx.pages(spark, d)
    footer = F.regexp_extract(F.col("html"), r"(?s)<footer>(.*?)</footer>", 1)
    return p.select("page_id", strip_html_full(footer).alias("footer"))


def q_wls_dose_pvalues(spark, d):
    """D10 with two-sided p-values of Student's t."""
    return _round(E.wls(_weighted(spark, d), "y", "dose", "ipw_weight").drop("r_squared", "n"), ["coef", "se", "t_stat", "p_value"])


def q_page_text(spark, d):
    """H2 with the full entity table over whole pages."""
    return fx.pages(spark, d).select("page_id", strip_html_full("html").alias("text"))


def q_survey_metadata(spark, d):
    """A2 + A6 + A7 + C1 from raw files: codebooks in ISO-8859-1 written from the pages, read block by block."""
    p = fx.pages(spark, d)
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    rows = F.transform(F.regexp_extract_all("html", F.lit(CB.LINK_PATTERN), F.lit(1)), lambda v: F.concat(
        F.lit("<tr>\n<td class='v'>"), v, F.lit("</td><td><i>"), F.lit("Entry &amp; "), v, F.lit("</i></td></tr>")))
    block = F.concat(F.lit(CB.BLOCK_START), title, F.lit("<br>Section&nbsp;Name:&nbsp;Pages of "), F.regexp_extract("url", "://([^/]*)", 1),
                     F.lit("<br>SAS&nbsp;Variable&nbsp;Name:&nbsp; PAGE"), F.col("page_id").cast("string"), F.lit(" <br><table>"),
                     F.array_join(rows, ""), F.lit("</table>"))
    path = scratch_path(spark, "codebook")
    p.where(title != "").select(F.encode(F.translate(block, "\u2019\u2026\u2013", "'.-"), "ISO-8859-1").cast("string")).write.text(path)
    return CB.codebook_metadata(CB.read_blocks(spark, path, "windows-1252"))


def q_fallback_read(spark, d):
    """A3: a delimited file that isn't valid in the first character set is read in the second."""
    p = fx.pages(spark, d).select("page_id", F.trim(F.regexp_extract("html", r"<title>([A-Za-zÀ-ÿ ]*)", 1)).alias("title"))
    path = scratch_path(spark, "fallback")
    p.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return read_table(spark, path, "csv", schema="page_id long, title string", encoding="UTF-8", fallback_encoding="ISO-8859-1")


def q_row_id_file_order(spark, d):
    """A5: ids in the order of the file."""
    return read_in_file_order(spark, f"{d}/orders.parquet", "row_id").select("row_id", "o_orderkey")


def q_standardize(spark, d):
    z = standardize(fx.units(spark, d).select("id", "acctbal", "n_orders", "dose"),
                    ["acctbal", "n_orders", "dose"], suffix="_z")
    return _round(z.select("id", "acctbal_z", "n_orders_z", "dose_z"), ["acctbal_z", "n_orders_z", "dose_z"])


def q_ipw_weights(spark, d):
    return E.ipw_weights(_scored(spark, d).select("id", "treated", "ps"), "ps", "treated")


def q_ipw_weights_edges(spark, d):
    """Scores of 0 and 1 give infinite weights in one arm, which go, and customers without a score have none."""
    ps = F.when(F.col("ps") < 0.05, 0.0).when(F.col("ps") > 0.95, 1.0).otherwise(F.col("ps"))
    return E.ipw_weights(q_join_left_scores(spark, d).withColumn("ps", ps), "ps", "treated")


def q_balance_reuse_weighted(spark, d):
    """D1 with Q12's reuse: controls weigh as often as matching used them."""
    b = B.weighted_balance(_reuse_weighted(spark, d), COVS, "treated", "match_weight")
    return _round(b, [c for c in b.columns if c != "variable"])


def q_effect_reuse_weighted(spark, d):
    return _round(E.weighted_treatment_effect(_reuse_weighted(spark, d), "outcome", "treated", "match_weight"), ["value"])


def _reuse_weighted(spark, d):
    s = _scored(spark, d)
    return reliable_checkpoint(reuse_weights(s, match_nearest(s, "ps_tied", "treated", "id", CALIPER, 2), "id"))


def q_ipw_effect(spark, d):
    return _wls_round(E.wls(_weighted(spark, d), "y", "treated", "ipw_weight"))


def q_trend_line(spark, d):
    w = _weighted(spark, d)
    ext = w.agg(F.min("dose").alias("mn"), F.max("dose").alias("mx")).first()
    return _round(E.trend_line(E.wls(w, "y", "dose", "ipw_weight"), ext["mn"], ext["mx"], "dose", 100),
                  ["x", "y_hat"])


def q_stream_preprocess(spark, d):
    """Structured Streaming: the orders file as a stream -> coded shape -> stateless recodes -> sink."""
    src = f"{d.rstrip('/')}/orders*.parquet"  # a file stream watches a folder or glob
    out = preprocess_stream(spark, src, fx.ORDERS_SCHEMA, lambda s: coded_recodes(fx.coded_from_orders(s)))
    return _round(out.drop(*CODED_RAW), ["severity", "combo_index"])


def q_preprocess_recodes(spark, d):
    out = coded_preprocess(fx.coded(spark, d))
    return _round(out, ["severity", "severity_normalized", "score_total_normalized", "combo_index",
                        "combo_index_normalized"])


def q_preprocess_pipeline(spark, d):
    """The survey's 12 recode groups over all its columns, on a stand-in of its codes."""
    out = survey_preprocess(survey_rows(fx.table(spark, d, "orders"), TARGET_VARIABLES))
    return _round(out, [f.name for f in out.schema.fields if f.dataType.typeName() == "double"])


def _survey(spark, d) -> DataFrame:
    """The survey stand-in, preprocessed, with its treatment and outcome flags, interaction columns and a supplied score."""
    # the recodes are a wide projection that several steps read: they are written once
    done = reliable_checkpoint(survey_preprocess(survey_rows(fx.table(spark, d, "orders"), TARGET_VARIABLES, "_SEQNO"), keep=["_SEQNO"]))
    score = sum((F.col(c) for c in NUMERIC[1:]), F.col(NUMERIC[0])) / F.lit(4.0)
    return reliable_checkpoint(SP.with_survey_interactions(define_survey_variables(done)).withColumn("ps", score))


def q_survey_interactions(spark, d):
    """B21 on the survey: the interaction columns of the specification test."""
    return _survey(spark, d).select("_SEQNO", "SEXVAR_AGE_INTERACTION", "INCOME_EDUCA_INTERACTION", F.round(
        "DISABILITY_EMPLOYMENT_INTERACTION", 6).alias("DISABILITY_EMPLOYMENT_INTERACTION"))


def _survey_matching(spark, d) -> MatchingAnalysis:
    # the score is none of the confounders: it goes along under a name of its own
    m = MatchingAnalysis(_survey(spark, d), "_SEQNO", "_EXERCISE_BINARY", "_MENTAL_HEALTH_BINARY", [*NUMERIC, *LABELLED, "ps"], LABELLED)
    return m.run(score_col="ps")


def q_survey_matching_scored(spark, d):
    """J11 on survey columns with a supplied score: balance after matching."""
    return _round(_survey_matching(spark, d).balance_after(), ["treated_mean", "control_mean", "smd"])


def q_survey_matching_effect(spark, d):
    return _round(_survey_matching(spark, d).effect(), ["value"])


def q_survey_spec_balance(spark, d):
    """J9 on survey columns with supplied scores: each covariate's balance in every specification and setting."""
    s = prepare(_survey(spark, d), "_SEQNO", "_EXERCISE_BINARY", "_MENTAL_HEALTH_BINARY", [*NUMERIC, *LABELLED, "ps"], LABELLED)
    s = reliable_checkpoint(s.withColumn("ps_half", F.col("ps") / F.lit(2.0)))
    test = SP.spec_test_with_scores(s, {"minimal": "ps", "standard": "ps_half"}, {"minimal": NUMERIC, "standard": [*NUMERIC, *LABELLED]},
                                    "_SEQNO", "_EXERCISE_BINARY", "_MENTAL_HEALTH_BINARY", SPEC_GRID)
    return _round(test.balance, ["treated_mean", "control_mean", "smd"])


def q_survey_weighting_scored(spark, d):
    """J12 on survey columns with a supplied score: the weighted effect of the treatment on the share of days in poor mental health."""
    w = WeightingAnalysis(_survey(spark, d), "_SEQNO", "_EXERCISE_BINARY", "MENTHLTH_MAPPED", "DISABILITY_INDEX", [*NUMERIC, *LABELLED], LABELLED)
    return _wls_round(w.prepare(score_col="ps").effect())


def q_subgroup_filter(spark, d):
    return q_subgroup_effects(spark, d).where(F.col("subgroup") == "Region")


# ---- model queries (checked by rows and by our own numeric tests) ----------------------

def _unit_analysis(spark, d) -> MatchingAnalysis:
    return MatchingAnalysis(fx.units(spark, d), "id", "treated", "outcome", UNIT_CONFOUNDERS, UNIT_CATEGORICAL)


def q_ps_random_forest(spark, d):
    m = _unit_analysis(spark, d).prepare().fit_scores("random_forest")
    return m.scored.select("id", "treated", "propensity_score")


def q_ps_logistic(spark, d):
    m = _unit_analysis(spark, d).prepare().fit_scores("logistic")
    return _round(m.scored.select("id", "treated", "propensity_score"), ["propensity_score"])


def q_ps_best_model(spark, d):
    m = _unit_analysis(spark, d).prepare()
    std = standardize(m.analysis, m.confounders, suffix="_z")
    scored, name, auc = P.best_model(std, [c + "_z" for c in m.confounders], "treated")
    return scored.select("id", "treated", "propensity_score").withColumn("model", F.lit(name)) \
        .withColumn("auc", F.lit(float(auc)))


def q_feature_importance(spark, d):
    return _unit_analysis(spark, d).prepare().fit_scores("random_forest").feature_importance()


def q_model_score_shape(spark, d):
    """Ids, arms and range of the fitted scores of both models (their values have no SQL form)."""
    m = _unit_analysis(spark, d).prepare()
    out = None
    for name in ("logistic", "random_forest"):
        s = m.fit_scores(name).scored.groupBy("treated").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("id").alias("id_sum"),
            F.min(F.col("propensity_score").between(0, 1)).alias("in_range")).withColumn("model", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def q_feature_importance_shape(spark, d):
    """The confounders of the forest, that their importances are shares, and that these add up to 1."""
    f = _unit_analysis(spark, d).prepare().fit_scores("random_forest").feature_importance()
    total = F.round(F.sum("importance").over(Window.partitionBy()), 6)  # one row a confounder
    return f.select("confounder", F.col("importance").between(0, 1).alias("is_share"), total.alias("total"))


def q_matching_analysis_scored(spark, d):
    """J11 on supplied scores: the whole analysis against SQL."""
    m = MatchingAnalysis(_scored(spark, d), "id", "treated", "outcome", ["ps", "acctbal", "n_orders", "dose"])
    return _round(m.run(score_col="ps").effect(), ["value"])


def q_ipw_analysis_scored(spark, d):
    """J12 on supplied scores: the dose response of the whole analysis against SQL."""
    w = WeightingAnalysis(_scored(spark, d), "id", "treated", "y", "dose", UNIT_CONFOUNDERS, UNIT_CATEGORICAL, SUBGROUPS)
    return _round(w.prepare(score_col="ps").dose_response(), ["mean", "se", "ci_lower", "ci_upper"])


def q_spec_grid(spark, d):
    u = fx.units(spark, d)
    coded = interaction_terms(category_codes(u, ["segment", "nation"], suffix="_code"),
                              {"segment_nation": ("segment_code", "nation_code"),
                               "segment_age_proxy": ("segment_code", 50)})
    specs = {
        "minimal": ["acctbal"],
        "standard": ["acctbal", "n_orders"],
        "comprehensive": ["acctbal", "n_orders", "dose"],
        "extended": ["acctbal", "n_orders", "dose", "segment", "nation"],
        "enhanced_interactions": ["acctbal", "n_orders", "dose", "segment", "nation", "segment_nation",
                                  "segment_age_proxy"],
        "full_model": ["acctbal", "n_orders", "dose", "segment", "nation", "region"],
    }
    return SP.spec_grid(coded, specs, "id", "treated", "outcome", ["segment", "nation", "region"])


def q_ipw_analysis(spark, d):
    wa = WeightingAnalysis(fx.units(spark, d), "id", "treated", "y", "dose", UNIT_CONFOUNDERS, UNIT_CATEGORICAL,
                           SUBGROUPS).prepare()
    return wa.dose_response()


def q_matching_analysis(spark, d):
    m = _unit_analysis(spark, d).run()
    return m.effect()


def entry_query(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: fitted forest scores -> caliper matching -> matched-cohort effect table."""
    return q_matching_analysis(spark, d)


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}

# model fits and the fitted-score grid have no SQL form: they get the weaker rows-only check
NON_SQL = {"ps_random_forest", "ps_best_model", "feature_importance", "spec_grid", "ipw_analysis", "matching_analysis"}

__all__ = ["QUERIES", "NON_SQL", "entry_query"]
