"""Readable text report, one block per tested specification, built as a string column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# FIXED VALUES: the report's title and the rule between blocks
TITLE = "Enhanced PSM Specification Testing Summary\n" + "=" * 50 + "\n"
RULE = "-" * 40


def spec_report_lines(results: DataFrame) -> DataFrame:
    """One report block (a multi-line string) per specification result row."""
    block = F.format_string(
        "Specification: %s\nConfiguration: caliper=%s, ratio=%d, algorithm=%s\nNumber of confounders: %d\n"
        "Sample sizes - Treated: %d, Control: %d\nSuccessful matches: %d\nPropensity score AUC: %.4f\n"
        "Average absolute standardized difference: %.4f\nTreatment effect: %.4f\n\n" + RULE + "\n",
        F.col("spec_name"), F.col("caliper").cast("string"), F.col("ratio"), F.col("algorithm"),
        F.col("n_confounders"), F.col("n_treated"), F.col("n_control"), F.col("n_matches"),
        F.col("auc"), F.col("avg_abs_std_diff"), F.col("treatment_effect"))
    return results.select("spec_name", "caliper", "ratio", block.alias("report"))


def spec_report_document(results: DataFrame) -> DataFrame:
    """The whole report: (position, text), the title first and then the blocks in the order of spec, caliper and ratio.

    There is one row per tested setting, so one task orders them.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("spec_name", "caliper", "ratio")
    blocks = spec_report_lines(results).select(F.row_number().over(order).alias("position"), F.col("report").alias("text"))
    title = results.sparkSession.range(1).select(F.lit(0).alias("position"), F.lit(TITLE).alias("text"))
    return title.unionByName(blocks)


def write_spec_report(results: DataFrame, path: str) -> None:
    """Write the report as a text file: title, then one block per line group."""
    spec_report_document(results).orderBy("position").select("text").coalesce(1).write.mode("overwrite").text(path)
