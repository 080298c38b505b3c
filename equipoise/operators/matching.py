"""Caliper nearest-neighbour matching (1:k, with replacement) without comparing all pairs.

For every treated score ``s`` the k nearest controls within the caliper are
among the k first controls above ``s`` (order: score asc, id asc) and the k
first controls at or below ``s`` (order: score desc, id asc).  Both lists come
from one global rank of the controls (``cumulative_sum``): a treated score's
position among the controls tells which control ranks to fetch, and the fetch is
an equi-join on rank.  Cost is O(n log n + k * distinct treated scores).

Treated rows are first reduced to distinct scores (map-side aggregated), so a
score shared by many treated rows is matched once; the joins on rank and back
to the treated rows on the score send hot keys through a broadcast branch
(``hot_key_join``), so one score holding a third of the rows does not land in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equipoise.operators.joins import DEFAULT_SHARE, hot_key_join, hot_keys_from_counts
from equipoise.operators.ranking import cumulative_sum
from equipoise.session import reliable_checkpoint


def _neighbours(controls: DataFrame, probes: DataFrame, k: int, hot_share: float = DEFAULT_SHARE,
                hot_min_rows: int = 10_000, n_probes: int | None = None, n_specs: int = 1) -> DataFrame:
    """For each spec's probe scores the first k controls above and the first k at or below, by that spec's scores.

    ``controls``: (_spec, control_id, ps_control); ``probes``: (_spec, ps_treated) distinct.
    Side 0 orders controls by (score asc, id asc) and places a probe after
    controls of equal score ("above" excludes equal scores); side 1 negates the
    score so that the order is (score desc, id asc) and places a probe before
    controls of equal score ("at or below" includes them).  One distributed
    ranking over all specs and both sides gives each control its rank and each probe its
    position; the k ranks after a probe's position are fetched by one equi-join.
    Returns (_spec, ps_treated, control_id, ps_control).
    """
    id_type = controls.schema["control_id"].dataType
    parts = []
    for side, sign, ctrl_tie, probe_tie in ((0, 1.0, 0, 1), (1, -1.0, 1, 0)):
        parts.append(controls.select(
            "_spec", F.lit(side).alias("_side"), (F.col("ps_control") * sign).alias("_key"), F.lit(ctrl_tie).alias("_tie"),
            F.col("control_id").alias("_id"), F.col("ps_control"), F.lit(1).alias("_is_ctrl")))
        parts.append(probes.select(
            "_spec", F.lit(side).alias("_side"), (F.col("ps_treated") * sign).alias("_key"), F.lit(probe_tie).alias("_tie"),
            F.lit(None).cast(id_type).alias("_id"), F.lit(None).cast("double").alias("ps_control"),
            F.lit(0).alias("_is_ctrl")))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    place = ["_spec", "_side", "_rank"]
    # several steps below read the ranking: it is made once
    ranked = reliable_checkpoint(cumulative_sum(both, "_is_ctrl", ["_key", "_tie", "_id"], partition_by=["_spec", "_side"],
                                                out="_rank", groups_bound=2 * n_specs))
    ctrl_by_rank = ranked.where("_is_ctrl = 1").select(*place, F.col("_id").alias("control_id"), "ps_control")
    positions = ranked.where("_is_ctrl = 0")
    wanted = positions.select(
        "_spec", "_side", F.when(F.col("_side") == 0, F.col("_key")).otherwise(-F.col("_key")).alias("ps_treated"),
        F.explode(F.sequence(F.col("_rank"), F.col("_rank") + (k - 1))).alias("_rank"))
    # many probes can ask for the same rank (dense treated scores between sparse controls): a hot
    # position makes its k ranks hot; positions come from the checkpointed ranking, so counting is cheap
    pos_counts = positions.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    total = None if n_probes is None else 2 * n_probes  # every probe has one position per side
    hot_pos = hot_keys_from_counts(pos_counts, place, "_n", hot_share, hot_min_rows, total)
    hot = sorted({(spec, side, pos + j) for spec, side, pos in hot_pos for j in range(k)})
    return hot_key_join(wanted, ctrl_by_rank, place, "inner", hot=hot).drop("_side", "_rank")


def match_scores(df: DataFrame, scores: dict[str, str], treatment: str, id_col: str, settings,
                 hot_share: float = DEFAULT_SHARE, hot_min_rows: int = 10_000) -> DataFrame:
    """C5/C6 for several scores (spec name -> score column) and several (caliper, ratio) settings in ONE pass.

    Adds ``spec`` and ``setting`` (index into ``settings``).  All scores share one ranking and one rank join, with the
    spec as part of the key.  Candidates are fetched once for the largest ratio; each setting then keeps
    the candidates within its caliper and its ``ratio`` nearest by
    (distance, control id).  Matching is with replacement; treated rows without
    a control inside the caliper are dropped, and rows without a score take no part.
    """
    settings = [(float(c), int(r)) for c, r in settings]
    if not scores or not settings or min(r for _, r in settings) < 1:
        raise ValueError("a score, and every setting with ratio >= 1, is needed")
    k = max(r for _, r in settings)
    names = list(scores)
    each = F.array(*[F.struct(F.lit(i).alias("_spec"), F.col(f"`{c}`").cast("double").alias("_ps")) for i, c in enumerate(scores.values())])
    # the narrow (id, arm, score) projection is read by the range sample, the ranking checkpoint and the
    # final join: write it once to the shared checkpoint folder -- the input pipeline runs once, every
    # later plan starts from this small table, and lineage is cut for lost executors
    base = reliable_checkpoint(df.select(F.col(id_col).alias("_id"), F.col(treatment).alias("_t"), F.inline(each))
                               .where(F.col("_ps").isNotNull()))
    treated = base.where(F.col("_t") == 1).select("_spec", F.col("_id").alias("treated_id"), F.col("_ps").alias("ps_treated"))
    controls = base.where(F.col("_t") == 0).select("_spec", F.col("_id").alias("control_id"), F.col("_ps").alias("ps_control"))
    # distinct treated scores with their multiplicity (map-side combined), written once: the ranking and the
    # hot-score question both read it
    key = ["_spec", "ps_treated"]
    score_counts = reliable_checkpoint(treated.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")))
    probes = score_counts.select(*key)

    sizes = score_counts.agg(F.count(F.lit(1)).alias("probes"), F.sum("_n").alias("treated")).first()
    cand = _neighbours(controls, probes, k, hot_share, hot_min_rows, sizes["probes"], len(names))
    cand = cand.withColumn("distance", F.abs(F.col("ps_control") - F.col("ps_treated")))
    cand = cand.where(F.col("distance") <= F.lit(max(c for c, _ in settings)))
    grid = F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(c).alias("_cal"), F.lit(r).alias("_ratio"))
                     for i, (c, r) in enumerate(settings)])
    cand = cand.withColumn("_s", F.explode(grid)).select("*", "_s.*").drop("_s")
    cand = cand.where(F.col("distance") <= F.col("_cal"))
    # at most 2 * k candidates per (spec, setting, treated score): a bounded window
    w = Window.partitionBy("setting", *key).orderBy("distance", "control_id")
    best = cand.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("_ratio")) \
        .drop("_rn", "_cal", "_ratio")
    # back to every treated row of that score; a score shared by many treated rows is a hot key
    hot = hot_keys_from_counts(score_counts, key, "_n", hot_share, hot_min_rows, sizes["treated"] or 0)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_spec") + 1)
    return hot_key_join(treated, best, key, "inner", hot=hot).select(
        name.alias("spec"), "setting", "treated_id", "control_id", "ps_treated", "ps_control", "distance")


def match_grid(df: DataFrame, score: str, treatment: str, id_col: str, settings,
               hot_share: float = DEFAULT_SHARE, hot_min_rows: int = 10_000) -> DataFrame:
    """``match_scores`` of one score."""
    return match_scores(df, {score: score}, treatment, id_col, settings, hot_share, hot_min_rows).drop("spec")


def match_nearest(df: DataFrame, score: str, treatment: str, id_col: str,
                  caliper: float = 0.05, ratio: int = 1) -> DataFrame:
    """Each treated row takes its ``ratio`` nearest controls with ``|diff| <= caliper``.

    Matching is with replacement; ties go to the smaller (distance, control id);
    treated rows without a control inside the caliper are dropped.  Returns
    (treated_id, control_id, ps_treated, ps_control, distance).
    """
    return match_grid(df, score, treatment, id_col, [(caliper, ratio)]).drop("setting")


def match_optimal(df: DataFrame, score: str, treatment: str, id_col: str,
                  caliper: float = 0.05, ratio: int = 1) -> DataFrame:
    """The "optimal" request is served by nearest-neighbour matching, as in the reference."""
    return match_nearest(df, score, treatment, id_col, caliper, ratio)


def matched_ids(pairs: DataFrame) -> DataFrame:
    """G1: distinct ids of both sides of all pairs, in one pass (map-side de-duplicated before the shuffle)."""
    return pairs.select(F.explode(F.array("treated_id", "control_id")).alias("_mid")).distinct()


def matched_cohort(df: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """C4: rows of ``df`` whose id appears in any pair, each row once (a semi-join)."""
    ids = matched_ids(pairs).withColumnRenamed("_mid", id_col)
    return df.join(ids, id_col, "left_semi")


def matched_sides(df: DataFrame, pairs: DataFrame, id_col: str, treatment: str) -> DataFrame:
    """Spec-test variant (03a): treated rows among matched treated ids, controls among matched control ids.

    With ``spec`` or ``setting`` columns in ``pairs`` the result holds each one's sides (rows tagged by them).
    """
    by = [c for c in ("spec", "setting") if c in pairs.columns]
    sides = F.array(F.struct(F.col("treated_id").alias(id_col), F.lit(1).alias("_arm")),
                    F.struct(F.col("control_id").alias(id_col), F.lit(0).alias("_arm")))
    ids = pairs.select(*by, F.explode(sides).alias("_s")).select(*by, "_s.*").distinct()
    # ids are unique per (spec, setting, id, arm) and ``df`` has one row per id: no hot key on either side
    return df.join(ids, id_col).where(F.col(treatment) == F.col("_arm")).drop("_arm")


def reuse_weights(df: DataFrame, pairs: DataFrame, id_col: str, out: str = "match_weight") -> DataFrame:
    """Q12 with reuse: the matched cohort with each row's weight.

    A treated row weighs 1; of its k matches each takes 1 / k of that, so that a control weighs what all treated rows that
    use it give it and both arms weigh the same.
    """
    share = 1.0 / F.col("k")
    matches = pairs.groupBy("treated_id").agg(F.count(F.lit(1)).alias("k"))
    controls = pairs.join(matches, "treated_id").groupBy(F.col("control_id").alias(id_col)).agg(F.sum(share).alias(out))
    treated = matches.select(F.col("treated_id").alias(id_col), F.lit(1.0).alias(out))
    return df.join(treated.unionByName(controls), id_col)
