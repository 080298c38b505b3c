"""Sources and sinks: encoded page files, result tables written and read back, the text report."""

import os
import tempfile

from pyspark.sql import functions as F

from equipoise.plans import catalog
from equipoise.plans import fixtures as fx
from equipoise.plans.catalog import UNIT_CATEGORICAL, UNIT_CONFOUNDERS
from equipoise.plans.matching import MatchingAnalysis
from equipoise.plans.specs import spec_comparison_with_scores
from equipoise.sources.codebook import read_pages
from equipoise.sources.io import read_table, with_row_id
from equipoise.sources.report import write_spec_report

SF = "/root/testdata/sf0.001"


def test_read_pages_windows_1252(spark):
    folder = tempfile.mkdtemp(prefix="eq-pages-", dir="/tmp")
    with open(os.path.join(folder, "codebook.html"), "wb") as f:
        f.write("<p>Café – €</p>".encode("windows-1252"))
    got = read_pages(spark, folder, "windows-1252").first()
    assert got.html == "<p>Café – €</p>"


def test_matching_results_written_and_read_back(spark):
    m = MatchingAnalysis(fx.units(spark, SF), "id", "treated", "outcome", UNIT_CONFOUNDERS, UNIT_CATEGORICAL)
    m.run(score_col="acctbal")
    out = tempfile.mkdtemp(prefix="eq-results-", dir="/tmp")
    m.save(out, "csv")
    back = read_table(spark, f"{out}/treatment_effect_results", "csv", schema="metric string, value double")
    assert {r.metric for r in back.collect()} == {"Treated Outcome", "Control Outcome", "Treatment Effect", "SE",
                                                  "CI Lower", "CI Upper"}
    assert read_table(spark, f"{out}/matching_pairs", "csv").count() == m.pairs.count()


def test_row_id_only_when_missing(spark):
    df = spark.createDataFrame([(5, "a"), (3, "b")], "k int, v string")
    assert sorted((r.k, r.rid) for r in with_row_id(df, "rid", ["k"]).collect()) == [(3, 0), (5, 1)]
    assert with_row_id(df, "k", ["k"]).columns == ["k", "v"]


def test_spec_report_text(spark):
    scored = fx.scored(spark, SF)
    res = spec_comparison_with_scores(spark, scored, {"ps": "ps"}, ["acctbal"], "id", "treated", "outcome",
                                      [(0.05, 1)])
    out = tempfile.mkdtemp(prefix="eq-report-", dir="/tmp")
    write_spec_report(res, f"{out}/report")
    text = "\n".join(r.value for r in spark.read.text(f"{out}/report").collect())
    assert "Specification: ps" in text and "Configuration: caliper=0.05, ratio=1, algorithm=nearest" in text
    assert F is not None


def test_fallback_read_writes_in_as_many_tasks_as_it_reads(spark, tmp_path, monkeypatch):
    pages = [(i, "u", f"<title> {'Été' if i % 2 else 'Name'} {'abc'[i % 3]} </title>" if i < 7 else None) for i in range(8)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4, "page_id").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(catalog, "scratch_path", lambda s, name: f"{tmp_path}/written")
    rows = {(r.page_id, r.title) for r in catalog.q_fallback_read(spark, str(tmp_path)).collect()}
    assert rows == {(i, f"{'Été' if i % 2 else 'Name'} {'abc'[i % 3]}" if i < 7 else None) for i in range(8)}
    assert len(list((tmp_path / "written").glob("part-*"))) > 1
