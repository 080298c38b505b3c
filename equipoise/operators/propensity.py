"""Propensity models and score diagnostics.

The forest is a Spark ML estimator, the logistic model a distributed IRLS fit; scores stay
a column of the input DataFrame.  AUC is computed without collecting rows: scores are reduced
to per-distinct-score counts and a distributed running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.operators.logistic import LogisticFit, fit_logistics
from equipoise.operators.ranking import cumulative_sum

FEATURES = "_features"


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES).transform(df)


def _label(df: DataFrame, treatment: str) -> DataFrame:
    return df.withColumn("_label", F.col(treatment).cast("double"))


def fit_random_forest(df: DataFrame, features: Sequence[str], treatment: str, num_trees: int = 100,
                      max_depth: int = 5, min_instances_per_node: int = 1, seed: int = 42):
    """Random-forest propensity model (sqrt feature subsets, bootstrap, seeded).

    The copy leaves out the training summary: it holds the session, which can't be sent to a task any more once
    something in it was observed, and scoring sends the model with all it holds.
    """
    rf = RandomForestClassifier(featuresCol=FEATURES, labelCol="_label", numTrees=num_trees, maxDepth=max_depth,
                                minInstancesPerNode=min_instances_per_node, featureSubsetStrategy="sqrt",
                                seed=seed, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")
    return rf.fit(_label(assemble(df, features), treatment)).copy()


def fit_logistic(df: DataFrame, features: Sequence[str], treatment: str, C: float = 1.0) -> LogisticFit:
    """L2 logistic regression with scikit-learn's ``C`` objective."""
    return fit_logistics(df, {"model": features}, treatment, C)["model"]


def score(model, df: DataFrame, features: Sequence[str], out: str = "propensity_score") -> DataFrame:
    """Add P(treated) from a fitted model as a double column; helper columns are dropped."""
    if isinstance(model, LogisticFit):
        return df.withColumn(out, model.probability())
    scored = model.transform(assemble(df, features))
    return scored.withColumn(out, vector_to_array(F.col("_prob"))[1]).drop(FEATURES, "_prob", "_raw", "_pred", "_label")


def auc(df: DataFrame, score_col: str, label: str, by: Sequence[str] = (), groups_bound: int | None = None) -> DataFrame:
    """Tie-aware ROC AUC (ties count one half), as one row (auc, n_pos, n_neg), or one per group of ``by``.

    Per distinct score the positives and negatives are counted (map-side
    combined); a distributed running sum of negatives below each score gives
    AUC = sum_s pos(s) * (neg_below(s) + neg(s) / 2) / (P * N).
    """
    y = F.col(label)
    per = df.where(F.col(score_col).isNotNull()).groupBy(*by, F.col(score_col).cast("double").alias("_s")).agg(
        F.count(F.when(y == 1, F.lit(1))).alias("_pos"), F.count(F.when(y == 0, F.lit(1))).alias("_neg"))
    ranked = cumulative_sum(per, "_neg", ["_s"], partition_by=by, out="_below", groups_bound=groups_bound)
    return ranked.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)),
                     (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("auc"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))


def auc_value(df: DataFrame, score_col: str, label: str) -> float:
    return df.transform(lambda d: auc(d, score_col, label)).first()["auc"]


def feature_importance(model, features: Sequence[str], spark=None) -> DataFrame:
    """Forest feature importances, largest first (one row per feature)."""
    imp = model.featureImportances.toArray().tolist()
    spark = spark or SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "confounder string, importance double").orderBy(
        F.desc("importance"), "confounder")


def best_model(df: DataFrame, features: Sequence[str], treatment: str, rf_params: dict | None = None,
               out: str = "propensity_score"):
    """Fit logistic and forest models, keep the one with the greatest AUC.

    A model that can't be fitted to these data is skipped; any other failure, as a lost
    executor, is raised, for it must not decide which model is kept.  Returns
    (scored DataFrame, model name, auc); ValueError if no model is left.
    """
    candidates = {
        "logistic": lambda: fit_logistic(df, features, treatment),
        "random_forest": lambda: fit_random_forest(df, features, treatment, **(rf_params or {})),
    }
    best = (None, None, 0.0)
    for name, fit in candidates.items():
        try:
            model = fit()
        except IllegalArgumentException:
            continue
        scored = score(model, df, features, out)
        value = auc_value(scored, out, treatment)
        if value is not None and value > best[2]:
            best = (scored, name, value)
    if best[0] is None:
        raise ValueError("no propensity model could be fitted and ranked")
    return best
