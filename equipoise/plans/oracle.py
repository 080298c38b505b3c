"""Independent SQL (DuckDB dialect) for every registered query that has a SQL form.

The matcher's oracle is the plain theta join with ROW_NUMBER (all pairs) that the
engine itself avoids; the other oracles restate each operator's definition.
"""

from __future__ import annotations

from equipoise.plans.survey_config import TARGET_VARIABLES
from equipoise.plans.survey_oracle import LABELLED, LABELS, NUMERIC, SETTINGS, analysis_ctes, preprocess_sql

FIXTURES = """
o_agg AS (
  SELECT o_custkey, COUNT(*) AS n_orders,
         SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n_urgent,
         SUM(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS n_high,
         SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_filled
  FROM orders GROUP BY o_custkey),
units AS (
  SELECT c.c_custkey AS id,
         CASE WHEN o.n_urgent >= 3 THEN 1 ELSE 0 END AS treated,
         CASE WHEN 2 * o.n_filled >= o.n_orders THEN 1 ELSE 0 END AS outcome,
         CAST(o.n_filled AS DOUBLE) / CAST(o.n_orders AS DOUBLE) AS y,
         CAST(60 * o.n_high + 15 * (o.n_orders % 4) AS DOUBLE) AS dose,
         c.c_acctbal AS acctbal, CAST(o.n_orders AS DOUBLE) AS n_orders,
         c.c_mktsegment AS segment, n.n_name AS nation, r.r_name AS region
  FROM customer c
  JOIN o_agg o ON o.o_custkey = c.c_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey),
scored AS (
  SELECT u.*, (u.acctbal + 1000.0) / 11000.0 AS ps,
         CAST(floor((u.acctbal + 1000.0) / 110.0) AS DOUBLE) / CAST(100 AS DOUBLE) AS ps_tied
  FROM units u),
coded AS (
  SELECT o_orderkey AS id,
         CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 7 WHEN 3 THEN 9 ELSE NULL END AS yesno,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(1 + o_custkey % 9 AS INT) END AS scale5,
         CASE WHEN o_orderkey % 7 = 0 THEN 888 WHEN o_orderkey % 7 = 1 THEN 777
              WHEN o_orderkey % 7 < 4 THEN 100 + o_custkey % 100
              ELSE 200 + o_custkey % 100 END AS freq,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey * 7 + o_custkey) % 1000 END AS duration,
         CASE o_orderkey % 6 WHEN 0 THEN 88 WHEN 1 THEN 77 WHEN 2 THEN 99 ELSE 1 + o_custkey % 40 END AS days30,
         CASE WHEN o_orderkey % 17 = 0 THEN 7777 WHEN o_orderkey % 17 = 1 THEN 9999
              ELSE 90 + o_custkey % 200 END AS weight,
         CASE WHEN o_custkey % 2 = 0 THEN CAST(1 + o_orderkey % 4 AS INT) END AS part_a,
         CASE WHEN o_custkey % 3 = 0 THEN CAST(1 + o_orderkey % 3 AS INT) END AS part_b,
         CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE CAST(o_custkey % 8 AS VARCHAR) END AS text_num
  FROM orders)"""

LINK = r'<a href="([^"]*)">([^<]*)</a>'
LI = r"(?s)<li>(.*?)</li>"
COVS = ["acctbal", "n_orders", "dose", "ps_tied"]


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def q(ctes: str, final: str) -> str:
    extra = f",\n{ctes}" if ctes.strip() else ""
    return f"WITH {FIXTURES}{extra}\n{final}"


# ---- reusable SQL pieces -----------------------------------------------------------------

def weekly(col, wpm=4.345, never=None):
    v = f"TRY_CAST({col} AS INTEGER)"
    s = (f"CASE WHEN {v} BETWEEN 101 AND 199 THEN CAST({v} - 100 AS DOUBLE) "
         f"WHEN {v} BETWEEN 201 AND 299 THEN ({v} - 200) / {D(wpm)} ")
    if never is not None:
        s += f"WHEN {v} = {never} THEN {D(0)} "
    return s + "END"


def minutes(col):
    v = f"TRY_CAST({col} AS INTEGER)"
    return (f"CASE WHEN {v} BETWEEN 1 AND 759 THEN CAST({v} AS DOUBLE) "
            f"WHEN {v} BETWEEN 800 AND 959 THEN CAST(({v} - 800) * 60 AS DOUBLE) END")


def day_scale(col):
    v = f"TRY_CAST({col} AS DOUBLE)"
    return f"CASE WHEN {v} IN (77, 88, 99) THEN NULL WHEN {v} BETWEEN 1 AND 30 THEN {v} / {D(30)} END"


def recode(col, mapping, default=None):
    whens = " ".join(f"WHEN {col} = {k} THEN {('NULL' if v is None else lit(v))}" for k, v in mapping.items())
    tail = f" ELSE {lit(default)}" if default is not None else ""
    return f"CASE {whens}{tail} END"


def lit(v):
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return D(repr(v))
    return str(v)


YESNO = {1: 1, 2: 0, 7: None, 9: None}
SCALE5 = {1: 0, 2: 0.25, 3: 0.5, 4: 0.75, 5: 1, 7: None, 9: None}


def recode_float(col, mapping):
    whens = " ".join(f"WHEN {col} = {k} THEN {('NULL' if v is None else D(v))}" for k, v in mapping.items())
    return f"CASE {whens} END"


def coded_recoded_cte():
    return f"""cr AS (
  SELECT *, {recode('yesno', YESNO)} AS yesno_score,
         {recode_float('scale5', SCALE5)} AS scale5_score,
         {weekly('freq', 4.345, 888)} AS freq_weekly,
         {minutes('duration')} AS duration_min,
         {day_scale('days30')} AS days30_mapped
  FROM coded)"""


def row_sum(cols):
    return " + ".join(f"COALESCE(CAST({c} AS DOUBLE), {D(0)})" for c in cols)


def nn_count(cols):
    return " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in cols)


def row_mean(cols):
    return f"({row_sum(cols)}) / CAST(NULLIF({nn_count(cols)}, 0) AS DOUBLE)"


def pairs_cte(name, score="ps", caliper=0.05, ratio=1, src="scored"):
    return f"""{name} AS (
  SELECT treated_id, control_id, ps_treated, ps_control, distance FROM (
    SELECT t.id AS treated_id, k.id AS control_id, t.{score} AS ps_treated, k.{score} AS ps_control,
           abs(k.{score} - t.{score}) AS distance,
           ROW_NUMBER() OVER (PARTITION BY t.id ORDER BY abs(k.{score} - t.{score}), k.id) AS rn
    FROM {src} t JOIN {src} k ON abs(k.{score} - t.{score}) <= {D(caliper)}
    WHERE t.treated = 1 AND k.treated = 0 AND t.{score} IS NOT NULL AND k.{score} IS NOT NULL) m
  WHERE rn <= {ratio})"""


def cohort_cte(name, pairs, src="scored"):
    return f"""{name} AS (
  SELECT * FROM {src} WHERE id IN (SELECT treated_id FROM {pairs} UNION SELECT control_id FROM {pairs}))"""


def sides_cte(name, pairs, src="scored"):
    return f"""{name} AS (
  SELECT * FROM {src} WHERE treated = 1 AND id IN (SELECT treated_id FROM {pairs})
  UNION ALL
  SELECT * FROM {src} WHERE treated = 0 AND id IN (SELECT control_id FROM {pairs}))"""


def balance_cte(name, src, covs=COVS):
    parts = []
    for v in covs:
        x = f"CAST({v} AS DOUBLE)"
        parts.append(f"SELECT '{v}' AS variable, avg(CASE WHEN treated = 1 THEN {x} END) AS treated_mean, "
                     f"avg(CASE WHEN treated = 0 THEN {x} END) AS control_mean, "
                     f"stddev_samp(CASE WHEN treated = 1 THEN {x} END) AS ts FROM {src}")
    union = "\n  UNION ALL ".join(parts)
    return f"""{name}_raw AS (
  {union}),
{name} AS (
  SELECT variable, treated_mean, control_mean,
         CASE WHEN ts > 0 THEN (treated_mean - control_mean) / ts ELSE {D(0)} END AS smd FROM {name}_raw)"""


def weighted_cte(name="w", src="scored"):
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, CASE WHEN treated = 1 THEN {D(1)} / NULLIF(ps, 0) ELSE {D(1)} / NULLIF(1 - ps, 0) END AS ipw_weight
    FROM {src}) x WHERE ipw_weight IS NOT NULL AND NOT isnan(ipw_weight))"""


def dose_bins_ctes(src="w"):
    return f"""mx AS (SELECT max(dose) AS m FROM {src}),
le AS (SELECT {D(60)} * (ceil((m + {D(60)}) / {D(60)}) - 1) AS last_edge FROM mx),
binned AS (
  SELECT s.*, CASE WHEN s.dose >= 0 AND s.dose < le.last_edge THEN floor(s.dose / {D(60)}) * {D(60)} END
         AS dose_bin_start
  FROM {src} s, le),
b AS (SELECT printf('%.1f-%.1f', dose_bin_start, dose_bin_start + {D(59)}) AS dose_bin, dose_bin_start, y,
             ipw_weight FROM binned WHERE dose_bin_start IS NOT NULL),
f AS (SELECT dose_bin, dose_bin_start, sum(ipw_weight) AS W, sum(ipw_weight * y) AS Sy, count(*) AS cnt
      FROM b GROUP BY dose_bin, dose_bin_start HAVING sum(ipw_weight) <> 0),
m AS (SELECT dose_bin, dose_bin_start, Sy / W AS mean, W, cnt FROM f),
dv AS (SELECT b.dose_bin, b.dose_bin_start, sum(b.ipw_weight * power(b.y - m.mean, 2)) AS S2
       FROM b JOIN m ON b.dose_bin = m.dose_bin AND b.dose_bin_start = m.dose_bin_start
       GROUP BY b.dose_bin, b.dose_bin_start),
bins AS (SELECT m.dose_bin, m.dose_bin_start, m.mean, sqrt(dv.S2 / m.W / m.cnt) AS se, m.cnt AS count
         FROM m JOIN dv ON m.dose_bin = dv.dose_bin AND m.dose_bin_start = dv.dose_bin_start),
bins_ci AS (SELECT *, mean - 1.96 * se AS ci_lower, mean + 1.96 * se AS ci_upper FROM bins)"""


def wls_sql(src, y, x, w, term):
    return f"""z AS (SELECT CAST({y} AS DOUBLE) AS y_, CAST({x} AS DOUBLE) AS x_, CAST({w} AS DOUBLE) AS w_ FROM {src}
      WHERE {y} IS NOT NULL AND {x} IS NOT NULL AND {w} IS NOT NULL),
s AS (SELECT sum(w_ * x_) / sum(w_) AS xm, sum(w_ * y_) / sum(w_) AS ym FROM z),
f AS (SELECT sum(w_) AS W, count(*) AS n, any_value(xm) AS xm, any_value(ym) AS ym, sum(w_ * (x_ - xm) * (x_ - xm)) AS cxx,
             sum(w_ * (x_ - xm) * (y_ - ym)) AS cxy, sum(w_ * (y_ - ym) * (y_ - ym)) AS cyy FROM z, s),
g AS (SELECT *, cxy / NULLIF(cxx, 0) AS b FROM f),
h AS (SELECT *, ym - b * xm AS a, cyy - b * cxy AS rss FROM g),
k AS (SELECT *, rss / NULLIF(CAST(n - 2 AS DOUBLE), 0) AS s2 FROM h),
l AS (SELECT *, sqrt(s2 / NULLIF(cxx, 0)) AS se_b, sqrt(s2 * ({D(1)} / W + xm * xm / cxx)) AS se_a,
             1 - rss / NULLIF(cyy, 0) AS r2 FROM k),
terms AS (SELECT 'Intercept' AS term, a AS coef, se_a AS se, r2, n FROM l
          UNION ALL SELECT '{term}' AS term, b AS coef, se_b AS se, r2, n FROM l)"""


WLS_FINAL = ("SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / NULLIF(se, 0), 6) AS t_stat, "
             "round(r2, 6) AS r_squared, n FROM terms")


def t_tail(t, v):
    """Two-sided tail of Student's t by Simpson's rule over the angle atan(x / sqrt(v))."""
    angle = f"atan(abs({t}) / sqrt({v}))"
    integral = (f"(SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(cos({angle} * i / 2000), {v} - 1)) "
                f"FROM range(2001) g(i)) * {angle} / 6000")
    return f"greatest({D(0)}, 1 - 2 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt(pi()) * {integral})"


def auc_sql(src, score, name="auc_t"):
    return f"""{name}_per AS (SELECT CAST({score} AS DOUBLE) AS s, count(CASE WHEN treated = 1 THEN 1 END) AS pos,
                 count(CASE WHEN treated = 0 THEN 1 END) AS neg FROM {src} WHERE {score} IS NOT NULL GROUP BY 1),
{name}_cum AS (SELECT s, pos, neg, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS below FROM {name}_per),
{name} AS (SELECT SUM(pos * (below + neg / {D(2)})) / NULLIF(SUM(pos) * SUM(neg), 0) AS auc,
                  CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg FROM {name}_cum)"""


def strip_html(expr):
    e = f"regexp_replace({expr}, '<[^>]*>', '', 'g')"
    e = f"replace({e}, '&nbsp;', ' ')"
    e = f"replace({e}, chr(160), ' ')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        e = f"replace({e}, '{ent}', '{ch}')"
    return f"trim({e})"


def blocks_cte():
    return f"""blocks AS (
  SELECT page_id, unnest(regexp_extract_all(html, '{LI}', 1)) AS block,
         CAST(unnest(range(len(regexp_extract_all(html, '{LI}', 1)))) AS INTEGER) AS block_no
  FROM pages),
vrows AS (
  SELECT page_id, block_no, unnest(regexp_extract_all(block, '{LINK}', 1)) AS v,
         unnest(regexp_extract_all(block, '{LINK}', 2)) AS l
  FROM blocks),
vals AS (
  SELECT * FROM (SELECT page_id, block_no, {strip_html('v')} AS value, {strip_html('l')} AS value_label FROM vrows) x
  WHERE length(value) > 0 AND length(value_label) > 0)"""


def spec_rows_sql():
    ctes, selects = [], []
    covs = ["acctbal", "n_orders", "dose"]
    for spec in ("ps", "ps_tied"):
        ctes.append(auc_sql("scored", spec, name=f"auc_{spec}"))
        for i, (cal, ratio) in enumerate(SETTINGS):
            tag = f"{spec}_{i}"
            ctes.append(pairs_cte(f"p_{tag}", spec, cal, ratio))
            ctes.append(sides_cte(f"sd_{tag}", f"p_{tag}"))
            ctes.append(balance_cte(f"bal_{tag}", f"sd_{tag}", covs))
            selects.append(
                f"SELECT '{spec}' AS spec_name, {D(cal)} AS caliper, {ratio} AS ratio, 'nearest' AS algorithm, "
                f"{len(covs)} AS n_confounders, (SELECT count(*) FROM scored WHERE treated = 1) AS n_treated, "
                f"(SELECT count(*) FROM scored WHERE treated = 0) AS n_control, "
                f"(SELECT count(*) FROM p_{tag}) AS n_matches, round((SELECT auc FROM auc_{spec}), 6) AS auc, "
                f"round((SELECT avg(abs(smd)) FROM bal_{tag}), 6) AS avg_abs_std_diff, "
                f"round((SELECT avg(CASE WHEN treated = 1 THEN outcome END) - avg(CASE WHEN treated = 0 THEN outcome END)"
                f" FROM sd_{tag}), 6) AS treatment_effect")
    return ",\n".join(ctes) + ",\nspecs AS (\n" + "\nUNION ALL\n".join(selects) + ")"


def report_expr():
    nl = " || chr(10) || "
    fmt = nl.join(["'Specification: %s'", "'Configuration: caliper=%s, ratio=%d, algorithm=%s'",
                   "'Number of confounders: %d'", "'Sample sizes - Treated: %d, Control: %d'",
                   "'Successful matches: %d'", "'Propensity score AUC: %.4f'",
                   "'Average absolute standardized difference: %.4f'", "'Treatment effect: %.4f'",
                   "''", f"'{'-' * 40}'", "''"])
    return (f"printf({fmt}, spec_name, CAST(caliper AS VARCHAR), ratio, algorithm, n_confounders, n_treated, "
            f"n_control, n_matches, auc, avg_abs_std_diff, treatment_effect)")


def _cohort_ctes():
    return pairs_cte("pairs") + ",\n" + cohort_cte("cohort", "pairs")


def _bal_ba():
    return _cohort_ctes() + ",\n" + balance_cte("bb", "scored") + ",\n" + balance_cte("ba", "cohort")


def _subgroup_sql():
    w = weighted_cte()
    return w + f""",
ext AS (SELECT min(y) AS mn, max(y) AS mx FROM w),
edges AS (SELECT CASE WHEN mn = mx THEN mn - (CASE WHEN mn <> 0 THEN 0.001 * abs(mn) ELSE 0.001 END) ELSE mn END AS lo,
                 CASE WHEN mn = mx THEN mx + (CASE WHEN mx <> 0 THEN 0.001 * abs(mx) ELSE 0.001 END) ELSE mx END AS hi,
                 mn = mx AS same FROM ext),
e AS (SELECT CASE WHEN same THEN lo ELSE lo - (hi - lo) * {D(0.001)} END AS b0,
             1 * ((hi - lo) / 3) + lo AS b1, 2 * ((hi - lo) / 3) + lo AS b2, hi AS b3 FROM edges),
fr AS (SELECT w.*, CASE WHEN y > b0 AND y <= b1 THEN 'Poor' WHEN y > b1 AND y <= b2 THEN 'Fair'
                        WHEN y > b2 AND y <= b3 THEN 'Good' END AS baseline FROM w, e),
lng AS (SELECT 'Segment' AS subgroup, segment AS category, y, treated, ipw_weight FROM fr
        UNION ALL SELECT 'Nation', nation, y, treated, ipw_weight FROM fr
        UNION ALL SELECT 'Region', region, y, treated, ipw_weight FROM fr
        UNION ALL SELECT 'Outcome Baseline', baseline, y, treated, ipw_weight FROM fr),
sg AS (SELECT subgroup, category,
              sum(CASE WHEN treated = 1 THEN ipw_weight END) AS w1,
              sum(CASE WHEN treated = 1 THEN ipw_weight * y END) AS s1,
              sum(CASE WHEN treated = 0 THEN ipw_weight END) AS w0,
              sum(CASE WHEN treated = 0 THEN ipw_weight * y END) AS s0, count(*) AS sample_size
       FROM lng WHERE category IS NOT NULL AND y IS NOT NULL AND ipw_weight IS NOT NULL
       GROUP BY subgroup, category HAVING count(*) >= 50),
effects AS (SELECT subgroup, category, round(s1 / NULLIF(w1, 0) - s0 / NULLIF(w0, 0), 6) AS effect, sample_size
            FROM sg)"""


def _severity():
    parts = [f"CASE WHEN freq BETWEEN 101 AND 199 THEN (freq - 100) / {D(30)} "
             f"WHEN freq BETWEEN 201 AND 299 THEN (freq - 200) / {D(4.3)} / {D(30)} END",
             f"CASE WHEN scale5 BETWEEN 1 AND 76 THEN scale5 / {D(15)} END",
             f"CASE WHEN days30 BETWEEN 1 AND 76 THEN days30 / {D(30)} END",
             f"CASE WHEN weight BETWEEN 1 AND 76 THEN weight / {D(15)} END"]
    return row_mean([f"({p})" for p in parts])


def _weighted_index(a="yesno_score", b="scale5_score", wa=0.4, wb=0.6):
    num = f"COALESCE({a} * {D(wa)}, {D(0)}) + COALESCE({b} * {D(wb)}, {D(0)})"
    den = (f"(CASE WHEN {a} IS NOT NULL THEN {D(wa)} ELSE {D(0)} END) + "
           f"(CASE WHEN {b} IS NOT NULL THEN {D(wb)} ELSE {D(0)} END)")
    return f"CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) END"


def _minmax(col, mode):
    mn = f"(SELECT min({col}) FROM pp)"
    mx = f"(SELECT max({col}) FROM pp)"
    zero = {"zero": D(0), "sklearn": f"CASE WHEN {col} IS NOT NULL THEN {D(0)} END"}.get(mode, "NULL")
    return f"CASE WHEN {mx} - {mn} = 0 THEN {zero} ELSE ({col} - {mn}) / ({mx} - {mn}) END"


def _hist_sql(bins=30):
    def edge(i):
        return f"(CASE WHEN {i} >= {bins} THEN mx ELSE {i} * step + mn END)"
    return f"""hs0 AS (SELECT treated, CAST(min(ps) AS DOUBLE) AS mn0, CAST(max(ps) AS DOUBLE) AS mx0
        FROM scored WHERE ps IS NOT NULL GROUP BY treated),
hs AS (SELECT treated, CASE WHEN mn0 = mx0 THEN mn0 - 0.5 ELSE mn0 END AS mn,
              CASE WHEN mn0 = mx0 THEN mx0 + 0.5 ELSE mx0 END AS mx FROM hs0),
hs2 AS (SELECT *, (mx - mn) / {D(bins)} AS step FROM hs),
j0 AS (SELECT s.treated, CAST(s.ps AS DOUBLE) AS x, h.mn, h.mx, h.step,
              LEAST(CAST(floor((s.ps - h.mn) / (h.mx - h.mn) * {bins}) AS INTEGER), {bins - 1}) AS i0
       FROM scored s JOIN hs2 h ON s.treated = h.treated WHERE s.ps IS NOT NULL),
j1 AS (SELECT *, CASE WHEN x < {edge('i0')} THEN i0 - 1 ELSE i0 END AS i1 FROM j0),
j2 AS (SELECT *, CASE WHEN x >= {edge('(i1 + 1)')} AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END AS i2 FROM j1),
cnt AS (SELECT treated, i2 AS i, count(*) AS c FROM j2 GROUP BY treated, i2),
grid AS (SELECT h.*, CAST(g.i AS INTEGER) AS i FROM hs2 h, range({bins}) g(i))"""


def _spec_balance_sql(specs=None, src="scored"):
    """Per covariate balance of two specifications: name -> (score, confounders)."""
    ctes, selects = [], []
    for spec, (score, covs) in (specs or {"ps": ("ps", ["acctbal", "n_orders", "dose"]), "ps_tied": ("ps_tied", ["acctbal", "dose"])}).items():
        for i, (cal, ratio) in enumerate(SETTINGS):
            tag = f"{spec}_{i}"
            ctes += [pairs_cte(f"p_{tag}", score, cal, ratio, src), sides_cte(f"sd_{tag}", f"p_{tag}", src), balance_cte(f"bal_{tag}", f"sd_{tag}", covs)]
            selects.append(f"SELECT '{spec}' AS spec_name, {D(cal)} AS caliper, {ratio} AS ratio, variable, round(treated_mean, 6) AS treated_mean, "
                           f"round(control_mean, 6) AS control_mean, round(smd, 6) AS smd FROM bal_{tag}")
    return ",\n".join(ctes), "\nUNION ALL\n".join(selects)


def _reuse_sql():
    """Matches 1:2 on the tied score; a control's weight is the sum of its shares in treated rows."""
    parts = [f"""SELECT '{v}' AS variable, treated, sum(w) AS sw, sum(w * w) AS sww, sum(w * {v}) / sum(w) AS m,
  sum(w * power({v} - (SELECT sum(w * {v}) / sum(w) FROM cw c2 WHERE c2.treated = cw.treated), 2)) AS sxx FROM cw GROUP BY treated"""
             for v in (*COVS, "outcome")]
    return pairs_cte("pr", "ps_tied", 0.05, 2) + """,
k AS (SELECT treated_id, count(*) AS k FROM pr GROUP BY treated_id),
wt AS (SELECT treated_id AS id, CAST(1 AS DOUBLE) AS w FROM k
       UNION ALL SELECT control_id, sum(CAST(1 AS DOUBLE) / k) FROM pr JOIN k USING (treated_id) GROUP BY control_id),
cw AS (SELECT s.*, wt.w FROM scored s JOIN wt USING (id)),
arms AS (""" + " UNION ALL ".join(parts) + """),
am AS (SELECT *, sqrt(sxx / NULLIF(sw - sww / sw, 0)) AS sd, sw * sw / sww AS ess FROM arms),
rb AS (SELECT t.variable, t.m AS treated_mean, c.m AS control_mean, CASE WHEN t.sd > 0 THEN (t.m - c.m) / t.sd ELSE CAST(0 AS DOUBLE) END AS smd,
              t.sd AS treated_sd, c.sd AS control_sd, t.ess AS treated_ess, c.ess AS control_ess
       FROM am t JOIN am c ON t.variable = c.variable AND t.treated = 1 AND c.treated = 0)"""


def _logistic_sql(steps=4000):
    """Ridge logistic regression on standardised confounders by plain gradient steps in a recursive CTE."""
    names = ["acctbal", "n_orders", "dose", "segment_code", "nation_code"]
    z = ", ".join(f"({c} - (SELECT avg({c}) FROM lc)) / (SELECT stddev_pop({c}) FROM lc)" for c in names)
    line = " + ".join(["b[1]", *(f"b[{i + 2}] * x[{i + 1}]" for i in range(len(names)))])
    slope = ["sum(p - treated)", *(f"sum((p - treated) * x[{i + 1}]) + any_value(b[{i + 2}])" for i in range(len(names)))]
    moved = ", ".join(f"any_value(b[{i + 1}]) - ({g}) / (0.5 * count(*) + 1)" for i, g in enumerate(slope))
    ctes = f"""lc AS (SELECT id, treated, acctbal, n_orders, dose, CAST(DENSE_RANK() OVER (ORDER BY segment) - 1 AS DOUBLE) AS segment_code,
             CAST(DENSE_RANK() OVER (ORDER BY nation) - 1 AS DOUBLE) AS nation_code FROM units),
lz AS MATERIALIZED (SELECT id, treated, [{z}] AS x FROM lc),
it AS (SELECT 0 AS k, [{', '.join([D(0)] * (len(names) + 1))}] AS b
       UNION ALL
       SELECT any_value(k) + 1, [{moved}] FROM (SELECT k, b, treated, x, 1 / (1 + exp(-({line}))) AS p FROM it, lz WHERE k < {steps}) HAVING count(*) > 0)"""
    return ctes, f"""SELECT id, treated, round(1 / (1 + exp(-({line}))), 6) AS propensity_score
FROM lz, (SELECT b FROM it WHERE k = {steps}) last"""


def _whole_text(expr):
    """Tags removed, the entities of the pages decoded once, white space at both ends removed."""
    e = f"replace(regexp_replace({expr}, '<[^\\n]*?>', '', 'g'), chr(160), ' ')"
    for ent, ch in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                    ("&nbsp;", "' || chr(160) || '"), ("&amp;", "&")):
        e = f"replace({e}, '{ent}', '{ch}')"
    return f"regexp_replace({e}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


# ---- the oracle table ------------------------------------------------------------------

def oracle_sql() -> dict[str, str]:
    S = {}
    S["scan_units"] = q("", "SELECT * FROM units")
    S["sink_roundtrip"] = q("", "SELECT * FROM units")
    S["row_id"] = q("", "SELECT id, yesno, ROW_NUMBER() OVER (ORDER BY id) - 1 AS row_id FROM coded")
    S["codebook_entries"] = q("", f"SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS target, "
                                  f"unnest(regexp_extract_all(html, '{LINK}', 2)) AS label FROM pages")
    S["codebook_values"] = q(blocks_cte(), "SELECT page_id, block_no, value, value_label FROM vals")
    S["spec_report"] = q(spec_rows_sql(), f"SELECT spec_name, caliper, ratio, {report_expr()} AS report FROM specs")
    S["select_available"] = q("", "SELECT id, treated, acctbal, segment FROM units")
    S["drop_available"] = q("", "SELECT id, treated, outcome, acctbal, n_orders, segment, nation, region FROM units")
    S["filter_isin"] = q("", "SELECT * FROM units WHERE segment IN ('BUILDING', 'MACHINERY')")
    S["filter_semijoin"] = q("", "SELECT id, nation, treated FROM units "
                                 "WHERE nation IN (SELECT nation FROM units WHERE treated = 1)")
    S["complete_cases"] = q("", "SELECT * FROM coded WHERE yesno IS NOT NULL AND scale5 IS NOT NULL "
                                "AND duration IS NOT NULL")
    S["treatment_flag"] = q("", f"SELECT id, CASE WHEN COALESCE(({weekly('freq', 4.345, 888)}) > 0, false) "
                                f"OR COALESCE(part_a - 2 > 0, false) OR COALESCE(part_b - 2 > 0, false) "
                                f"THEN 1 ELSE 0 END AS treated_flag FROM coded")
    S["outcome_flag"] = q("", f"SELECT id, CASE WHEN ({day_scale('days30')}) <= 0.5 THEN 1 ELSE 0 END AS outcome_flag "
                              f"FROM coded")
    S["recode_scores"] = q(coded_recoded_cte(), "SELECT id, yesno_score, scale5_score FROM cr")
    S["recode_labels"] = q("", f"SELECT id, {recode('scale5', LABELS['MARITAL'])} AS scale5_label FROM coded")
    vals = ", ".join(f"({k}, {D(v)})" for k, v in SCALE5.items() if v is not None)
    S["recode_lookup"] = q("", f"SELECT c.id, c.scale5, lk.scale5_value FROM coded c LEFT JOIN "
                               f"(VALUES {vals}) AS lk(scale5, scale5_value) ON c.scale5 = lk.scale5")
    S["null_special_codes"] = q("", "SELECT id, CASE WHEN weight IN (7777, 9999) THEN NULL ELSE weight END "
                                    "AS weight_clean FROM coded")
    fc = " + ".join(f"(CASE WHEN {c} = 1 THEN 1 ELSE 0 END)" for c in ("yesno", "part_a", "part_b"))
    S["flag_index"] = q("", f"SELECT id, {fc} AS flag_count, ({fc}) / {D(3)} AS flag_index FROM coded")
    S["frequency_code"] = q(coded_recoded_cte(), "SELECT id, freq, freq_weekly FROM cr")
    S["duration_code"] = q(coded_recoded_cte(), "SELECT id, duration, duration_min FROM cr")
    S["bounded_scale"] = q("", f"SELECT id, {day_scale('days30')} AS days30_mapped, "
                               f"CASE WHEN days30 BETWEEN 1 AND 30 THEN CAST(days30 AS DOUBLE) ELSE {D(0)} END "
                               f"/ {D(30)} AS days30_or_zero FROM coded")
    S["coalesce_score"] = q("", f"SELECT id, CASE COALESCE(part_a, part_b) WHEN 1 THEN {D(1)} WHEN 3 THEN {D(0.5)} "
                                f"ELSE {D(0)} END AS pair_score FROM coded")
    S["category_codes"] = q("", "SELECT id, segment, nation, "
                                "CAST(DENSE_RANK() OVER (ORDER BY segment) - 1 AS INTEGER) AS segment_code, "
                                "CAST(DENSE_RANK() OVER (ORDER BY nation) - 1 AS INTEGER) AS nation_code "
                                "FROM units WHERE segment IS NOT NULL AND nation IS NOT NULL AND id IS NOT NULL")
    S["coerce_numeric"] = q("", "SELECT id, text_num, TRY_CAST(text_num AS DOUBLE) AS text_value FROM coded")
    act = f"LEAST({row_sum(['freq_weekly', 'part_a'])}, {D(7)})"
    S["bin_fixed"] = q(coded_recoded_cte(), f"""SELECT id,
  CASE WHEN {act} > -1 AND {act} <= 0 THEN 'None' WHEN {act} > 0 AND {act} <= 2 THEN 'Low'
       WHEN {act} > 2 AND {act} <= 4 THEN 'Moderate' WHEN {act} > 4 AND {act} <= 7 THEN 'High' END AS activity_category,
  CASE WHEN days30_mapped > 0 AND days30_mapped <= 0.3 THEN 'Poor' WHEN days30_mapped > 0.3 AND days30_mapped <= 0.6
       THEN 'Fair' WHEN days30_mapped > 0.6 AND days30_mapped <= 1.0 THEN 'Good' END AS days_category
FROM cr""")
    S["bin_width"] = q("""mx AS (SELECT max(dose) AS m FROM units),
le AS (SELECT CAST(60 AS DOUBLE) * (ceil((m + CAST(60 AS DOUBLE)) / CAST(60 AS DOUBLE)) - 1) AS last_edge FROM mx),
bw AS (SELECT u.id, u.dose, CASE WHEN u.dose >= 0 AND u.dose < le.last_edge
                                 THEN floor(u.dose / CAST(60 AS DOUBLE)) * CAST(60 AS DOUBLE) END AS dose_bin_start
       FROM units u, le)""", "SELECT id, dose, dose_bin_start, CASE WHEN dose_bin_start IS NOT NULL THEN "
                             "printf('%.1f-%.1f', dose_bin_start, dose_bin_start + CAST(59 AS DOUBLE)) END AS dose_bin "
                             "FROM bw")
    S["bin_equal_width"] = q(f"""ext AS (SELECT min(y) AS mn, max(y) AS mx FROM units),
e AS (SELECT mn - (mx - mn) * {D(0.001)} AS b0, 1 * ((mx - mn) / 3) + mn AS b1, 2 * ((mx - mn) / 3) + mn AS b2,
             mx AS b3 FROM ext)""", """SELECT u.id, u.y, CASE WHEN y > b0 AND y <= b1 THEN 'Poor'
  WHEN y > b1 AND y <= b2 THEN 'Fair' WHEN y > b2 AND y <= b3 THEN 'Good' END AS y_band FROM units u, e""")
    wk = ["freq_weekly", "part_a", "part_b"]
    mins = ["duration_min", "weight_min"]
    sessions = " + ".join(f"CAST(COALESCE({c} > 0, false) AS INTEGER)" for c in wk)
    S["dose_measures"] = q(coded_recoded_cte() + f""",
dm AS (SELECT id, {row_sum(wk)} AS TOTAL_EX_DAYS, {row_sum(mins)} AS TOTAL_EX_MINUTES,
              LEAST({row_sum(wk)}, {D(7)}) AS EX_FREQUENCY, {sessions} AS sessions
       FROM (SELECT *, {minutes('weight')} AS weight_min FROM cr) c),
dm2 AS (SELECT *, CASE WHEN sessions > 0 THEN TOTAL_EX_MINUTES / sessions ELSE {D(0)} END
               AS EX_INTENSITY_PER_SESSION FROM dm)""", """SELECT id, TOTAL_EX_DAYS, TOTAL_EX_MINUTES, EX_FREQUENCY,
  EX_INTENSITY_PER_SESSION, EX_FREQUENCY * EX_INTENSITY_PER_SESSION AS EX_VOLUME,
  CASE WHEN EX_FREQUENCY > -1 AND EX_FREQUENCY <= 0 THEN 'None' WHEN EX_FREQUENCY > 0 AND EX_FREQUENCY <= 2 THEN 'Low'
       WHEN EX_FREQUENCY > 2 AND EX_FREQUENCY <= 4 THEN 'Moderate' WHEN EX_FREQUENCY > 4 AND EX_FREQUENCY <= 7
       THEN 'High' END AS EX_CATEGORY FROM dm2""")
    codes = ("cc AS (SELECT id, acctbal, CAST(DENSE_RANK() OVER (ORDER BY segment) - 1 AS INTEGER) AS segment_code, "
             "CAST(DENSE_RANK() OVER (ORDER BY nation) - 1 AS INTEGER) AS nation_code FROM units)")
    S["interaction_terms"] = q(codes, "SELECT id, segment_code * nation_code AS segment_nation, "
                                      "acctbal * segment_code AS acctbal_segment, segment_code * 50 AS segment_age_proxy "
                                      "FROM cc")
    S["member_flag"] = q("", "SELECT id, COALESCE(TRY_CAST(scale5 AS INTEGER) IN (1, 2, 4, 5, 7), false) "
                             "AS scale5_member FROM coded")
    S["bin_midpoint"] = q(weighted_cte() + ",\n" + dose_bins_ctes(), """SELECT * FROM (
  SELECT dose_bin, (CAST(split_part(dose_bin, '-', 1) AS DOUBLE) + CAST(split_part(dose_bin, '-', 2) AS DOUBLE)) / 2
         AS bin_midpoint, round(mean, 6) AS mean FROM bins_ci) x WHERE bin_midpoint BETWEEN 30 AND 500""")
    S["min_group_size"] = q("", "SELECT nation, count(*) AS count FROM units GROUP BY nation HAVING count(*) >= 50")
    S["join_left_labels"] = q(blocks_cte(), "SELECT p.page_id, p.url, v.block_no, v.value, v.value_label "
                                            "FROM pages p LEFT JOIN vals v ON p.page_id = v.page_id")
    S["join_left_scores"] = q("", "SELECT c.c_custkey AS id, s.treated, s.ps FROM customer c LEFT JOIN scored s ON c.c_custkey = s.id")
    S["balance_compare"] = q(_bal_ba(), """SELECT b.variable, round(abs(b.smd), 6) AS abs_smd_before,
  round(abs(a.smd), 6) AS abs_smd_after, round(abs(b.smd) - abs(a.smd), 6) AS improvement
FROM bb b JOIN ba a ON b.variable = a.variable""")
    S["matched_cohort"] = q(_cohort_ctes(), "SELECT id, treated, outcome, ps FROM cohort")
    S["match_nearest"] = q(pairs_cte("pairs"), "SELECT * FROM pairs")
    S["match_nearest_tight"] = q(pairs_cte("pairs", "ps", 0.0005, 1), "SELECT * FROM pairs")
    S["match_knn"] = q(pairs_cte("pairs", "ps_tied", 0.05, 2), "SELECT * FROM pairs")
    S["decode_categories"] = q("", "SELECT id, CAST(DENSE_RANK() OVER (ORDER BY segment) - 1 AS INTEGER) "
                                   "AS segment_code, segment AS segment_label FROM units WHERE segment IS NOT NULL")
    S["balance_before"] = q(balance_cte("bb", "scored"), "SELECT variable, round(treated_mean, 6) AS treated_mean, "
                            "round(control_mean, 6) AS control_mean, round(smd, 6) AS smd FROM bb")
    S["balance_after"] = q(_cohort_ctes() + ",\n" + balance_cte("ba", "cohort"),
                           "SELECT variable, round(treated_mean, 6) AS treated_mean, "
                           "round(control_mean, 6) AS control_mean, round(smd, 6) AS smd FROM ba")
    summ = ("SELECT round(avg(abs(smd)), 6) AS mean_abs_smd, round(max(abs(smd)), 6) AS max_abs_smd, "
            "count(CASE WHEN abs(smd) > 0.1 THEN 1 END) AS n_above_threshold, '{s}' AS stage FROM {t}")
    S["balance_summary"] = q(_bal_ba(), summ.format(s="before", t="bb") + " UNION ALL " +
                             summ.format(s="after", t="ba"))
    S["treatment_effect"] = q(_cohort_ctes() + """,
te AS (SELECT avg(CASE WHEN treated = 1 THEN CAST(outcome AS DOUBLE) END) AS mt,
              avg(CASE WHEN treated = 0 THEN CAST(outcome AS DOUBLE) END) AS mc,
              stddev_samp(CASE WHEN treated = 1 THEN CAST(outcome AS DOUBLE) END) AS st,
              stddev_samp(CASE WHEN treated = 0 THEN CAST(outcome AS DOUBLE) END) AS sc,
              count(CASE WHEN treated = 1 THEN 1 END) AS nt, count(CASE WHEN treated = 0 THEN 1 END) AS nc FROM cohort),
te2 AS (SELECT *, mt - mc AS ate, sqrt(power(st / sqrt(nt), 2) + power(sc / sqrt(nc), 2)) AS se FROM te)""",
                              """SELECT 'Treated Outcome' AS metric, round(mt, 6) AS value FROM te2
UNION ALL SELECT 'Control Outcome', round(mc, 6) FROM te2
UNION ALL SELECT 'Treatment Effect', round(ate, 6) FROM te2
UNION ALL SELECT 'SE', round(se, 6) FROM te2
UNION ALL SELECT 'CI Lower', round(ate - 1.96 * se, 6) FROM te2
UNION ALL SELECT 'CI Upper', round(ate + 1.96 * se, 6) FROM te2""")
    S["value_counts"] = q("", "SELECT segment, count(*) AS count FROM units GROUP BY segment")
    mm = ", ".join(f"(({c}) - (SELECT min({c}) FROM units)) / ((SELECT max({c}) FROM units) - "
                   f"(SELECT min({c}) FROM units)) AS {c}_NORMALIZED" for c in ("acctbal", "n_orders", "dose"))
    S["minmax_scale"] = q("", f"SELECT id, {mm} FROM units")
    three = ["yesno_score", "scale5_score", "days30_mapped"]
    S["row_sum"] = q(coded_recoded_cte(), f"SELECT id, {row_sum(three)} AS row_total FROM cr")
    S["row_mean"] = q(coded_recoded_cte(), f"SELECT id, {row_mean(three)} AS row_avg FROM cr")
    S["severity_score"] = q("", f"SELECT id, {_severity()} AS severity FROM coded")
    S["weighted_index"] = q(coded_recoded_cte(), f"SELECT id, {_weighted_index()} AS combo_index FROM cr")
    bins_final = ("SELECT dose_bin, dose_bin_start, round(mean, 6) AS mean, round(se, 6) AS se, count, "
                  "round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper FROM bins_ci")
    S["dose_response_bins"] = q(weighted_cte() + ",\n" + dose_bins_ctes(), bins_final)
    S["wls_dose"] = q(weighted_cte() + ",\n" + wls_sql("w", "y", "dose", "ipw_weight", "dose"), WLS_FINAL)
    S["wls_dose_pvalues"] = q(weighted_cte() + ",\n" + wls_sql("w", "y", "dose", "ipw_weight", "dose")
                              + ",\ntt AS (SELECT *, coef / NULLIF(se, 0) AS t, CAST(n - 2 AS DOUBLE) AS v FROM terms)",
                              "SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(t, 6) AS t_stat, "
                              f"round({t_tail('t', 'v')}, 6) AS p_value FROM tt")
    S["subgroup_pvalues"] = q(_subgroup_sql() + """,
ok AS (SELECT subgroup, category, y, CAST(treated AS DOUBLE) AS x, ipw_weight AS w FROM lng WHERE category IS NOT NULL),
mm AS (SELECT subgroup, category, sum(w) AS sw, sum(w * x) / sum(w) AS xm, sum(w * y) / sum(w) AS ym, count(*) AS n FROM ok
       GROUP BY ALL HAVING count(*) >= 50),
ss AS (SELECT subgroup, category, any_value(n) AS n, sum(w * (x - xm) * (x - xm)) AS cxx, sum(w * (x - xm) * (y - ym)) AS cxy,
              sum(w * (y - ym) * (y - ym)) AS cyy FROM ok JOIN mm USING (subgroup, category) GROUP BY subgroup, category),
bb AS (SELECT subgroup, category, n, cxy / NULLIF(cxx, 0) AS b, sqrt((cyy - cxy * cxy / NULLIF(cxx, 0)) / (n - 2) / NULLIF(cxx, 0)) AS se FROM ss),
tt AS (SELECT *, b / NULLIF(se, 0) AS t, CAST(n - 2 AS DOUBLE) AS v FROM bb)""",
                              "SELECT subgroup, category, round(b, 6) AS effect, n AS sample_size, round(se, 6) AS se, round(t, 6) AS t_stat, "
                              f"CASE WHEN t IS NOT NULL THEN round({t_tail('t', 'v')}, 6) END AS p_value FROM tt")
    S["subgroup_effects"] = q(_subgroup_sql(), "SELECT * FROM effects")
    S["auc"] = q(auc_sql("scored", "ps_tied"), "SELECT round(auc, 6) AS auc, n_pos, n_neg FROM auc_t")
    parts = []
    for v in ("acctbal", "n_orders", "dose", "y"):
        parts.append(f"SELECT '{v}' AS variable, count({v}) AS count, round(avg({v}), 6) AS mean, "
                     f"round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min, "
                     f"round(quantile_cont({v}, 0.25), 6) AS q25, round(quantile_cont({v}, 0.5), 6) AS q50, "
                     f"round(quantile_cont({v}, 0.75), 6) AS q75, round(max({v}), 6) AS max FROM units")
    S["describe"] = q("", " UNION ALL ".join(parts))
    S["histogram"] = q(_hist_sql(30), """SELECT g.treated, g.i AS bin, (CASE WHEN g.i >= 30 THEN g.mx ELSE g.i * g.step + g.mn END) AS bin_lo,
  (CASE WHEN g.i + 1 >= 30 THEN g.mx ELSE (g.i + 1) * g.step + g.mn END) AS bin_hi, COALESCE(c.c, 0) AS count
FROM grid g LEFT JOIN cnt c ON g.treated = c.treated AND g.i = c.i""")
    S["distinct_rows"] = q(blocks_cte(), "SELECT DISTINCT value, value_label FROM vals")
    S["sample_sizes"] = q(_cohort_ctes(), "SELECT 'before' AS stage, treated, count(*) AS n FROM scored GROUP BY treated "
                                          "UNION ALL SELECT 'after', treated, count(*) FROM cohort GROUP BY treated")
    S["balance_improvement"] = q(_bal_ba() + """,
cmp AS (SELECT abs(b.smd) AS bf, abs(a.smd) AS af FROM bb b JOIN ba a ON b.variable = a.variable)""",
                                 "SELECT round(avg(bf), 6) AS overall_before, round(avg(af), 6) AS overall_after, "
                                 "round(avg(bf) - avg(af), 6) AS improvement FROM cmp")
    S["top_covariates"] = q(balance_cte("bb", "scored"), """SELECT variable, round(treated_mean, 6) AS treated_mean,
  round(control_mean, 6) AS control_mean, round(smd, 6) AS smd, round(abs(smd), 6) AS abs_smd FROM bb
ORDER BY abs(smd) DESC, variable LIMIT 10""")
    S["spec_comparison"] = q(spec_rows_sql(), "SELECT * FROM specs")
    S["spec_labels"] = q(spec_rows_sql(), "SELECT spec_name || ' + caliper=' || CAST(caliper AS VARCHAR) || ', ratio=' || CAST(ratio AS VARCHAR) "
                         "AS label, n_matches, avg_abs_std_diff, treatment_effect FROM specs")
    S["spec_report_document"] = q(spec_rows_sql(), f"""SELECT 0 AS position, 'Enhanced PSM Specification Testing Summary' || chr(10) || repeat('=', 50) || chr(10) AS text
UNION ALL SELECT CAST(row_number() OVER (ORDER BY spec_name, caliper, ratio) AS INTEGER), {report_expr()} FROM specs""")
    S["spec_balance"] = q(*_spec_balance_sql())
    S["ps_logistic"] = q(*_logistic_sql()).replace("WITH ", "WITH RECURSIVE ", 1)
    S["row_id_file_order"] = "SELECT row_number() OVER () - 1 AS row_id, o_orderkey FROM orders"
    S["fallback_read"] = """SELECT page_id, NULLIF(trim(regexp_extract(html, '<title>([A-Za-zÀ-ÿ ]*)', 1)), '') AS title FROM pages"""
    S["page_text"] = f"SELECT page_id, {_whole_text('html')} AS text FROM pages"
    S["survey_metadata"] = f"""WITH p AS (SELECT page_id, translate(regexp_extract(html, '<title>(.*?)</title>', 1), '’…–', chr(39) || '.-') AS title,
       regexp_extract(url, '://([^/]*)', 1) AS host, list_distinct(regexp_extract_all(html, '{LINK}', 1)) AS links FROM pages),
v AS (SELECT page_id, unnest(links) AS link FROM p),
w AS (SELECT DISTINCT page_id, {_whole_text('link')} AS value, {_whole_text("'Entry &amp; ' || link")} AS label FROM v)
SELECT 'PAGE' || CAST(p.page_id AS VARCHAR) AS "SAS Variable Name", {_whole_text('title')} AS "Label", 'Pages of ' || host AS "Section Name",
       w.value AS "Value", w.label AS "Value Label"
FROM p LEFT JOIN (SELECT * FROM w WHERE value <> '') w ON p.page_id = w.page_id WHERE title <> ''"""
    S["balance_reuse_weighted"] = q(_reuse_sql(), "SELECT variable, " + ", ".join(
        f"round({c}, 6) AS {c}" for c in ("treated_mean", "control_mean", "smd", "treated_sd", "control_sd", "treated_ess", "control_ess"))
        + " FROM rb WHERE variable <> 'outcome'")
    S["effect_reuse_weighted"] = q(_reuse_sql() + """,
ef AS (SELECT *, treated_mean - control_mean AS ate, sqrt(treated_sd * treated_sd / treated_ess + control_sd * control_sd / control_ess) AS se
       FROM rb WHERE variable = 'outcome')""", " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round({x}, 6) AS value FROM ef" for m, x in (
            ("Treated Outcome", "treated_mean"), ("Control Outcome", "control_mean"), ("Treatment Effect", "ate"), ("SE", "se"),
            ("CI Lower", "ate - 1.96 * se"), ("CI Upper", "ate + 1.96 * se"), ("Treated ESS", "treated_ess"), ("Control ESS", "control_ess"))))
    S["best_spec"] = q(spec_rows_sql(), "SELECT * FROM specs ORDER BY avg_abs_std_diff, spec_name, caliper, ratio LIMIT 1")
    S["dose_curve_top20"] = q(weighted_cte() + ",\n" + dose_bins_ctes(),
                              bins_final + " WHERE count > 10 ORDER BY dose_bin_start LIMIT 20")
    S["clean_name"] = q("""t AS (SELECT page_id, COALESCE(regexp_extract(html, '<title>(.*?)</title>', 1), '') AS title
      FROM pages)""", """SELECT page_id, title, regexp_replace(trim(regexp_replace(regexp_replace(lower(title),
  '\\(.*?\\)', '', 'g'), '[^a-z0-9 ]+', '', 'g')), '\\s+', '_', 'g') AS clean FROM t""")
    S["strip_html"] = q(blocks_cte(), f"SELECT page_id, block_no, {strip_html('block')} AS text FROM blocks")
    zs = []
    for c in ("acctbal", "n_orders", "dose"):
        zs.append(f"round(({c} - (SELECT avg({c}) FROM units)) / (SELECT stddev_pop({c}) FROM units), 6) AS {c}_z")
    S["standardize"] = q("", f"SELECT id, {', '.join(zs)} FROM units")
    weight = f"CASE WHEN treated = 1 THEN {D(1)} / NULLIF(ps, 0) ELSE {D(1)} / NULLIF(1 - ps, 0) END"
    S["ipw_weights"] = q("", f"SELECT id, treated, ps, {weight} AS ipw_weight FROM scored WHERE ({weight}) IS NOT NULL")
    S["ipw_weights_edges"] = q(f"""e AS (SELECT id, treated, CASE WHEN ps < 0.05 THEN {D(0)} WHEN ps > 0.95 THEN {D(1)} ELSE ps END AS ps
      FROM scored)""", f"SELECT id, treated, ps, {weight} AS ipw_weight FROM e WHERE NOT (treated = 1 AND ps = 0 OR treated = 0 AND ps = 1)")
    S["filter_semijoin_regions"] = q("", "SELECT id, nation, treated FROM units WHERE region = 'ASIA'")
    S["category_codes_missing"] = q("", """SELECT id, segment, CASE WHEN segment IS NOT NULL THEN
  CAST(DENSE_RANK() OVER (ORDER BY segment NULLS LAST) - 1 AS INTEGER) END AS segment_code
FROM (SELECT id, NULLIF(segment, 'BUILDING') AS segment FROM units) z""")
    S["join_left_labels_unmatched"] = q(blocks_cte(), """SELECT p.page_id, p.url, v.block_no, v.value, v.value_label
FROM (SELECT page_id, url FROM pages UNION ALL SELECT -1 - page_id, url FROM pages) p LEFT JOIN vals v ON p.page_id = v.page_id""")
    many = " UNION ALL ".join(
        f"SELECT 'cov_{k:02d}' AS variable, (avg(v1) - avg(v0)) / stddev_samp(v1) AS smd FROM (SELECT CASE WHEN treated = 1 THEN "
        f"CAST(id % {k + 3} AS DOUBLE) END AS v1, CASE WHEN treated = 0 THEN CAST(id % {k + 3} AS DOUBLE) END AS v0 FROM scored) z{k}"
        for k in range(14))
    S["top_covariates_many"] = q(f"t AS ({many})", """SELECT CAST(n AS INTEGER) AS position, variable, round(smd, 6) AS smd
FROM (SELECT *, row_number() OVER (ORDER BY abs(smd) DESC, variable) - 1 AS n FROM t) z WHERE n < 10""")
    S["model_score_shape"] = q("", """SELECT treated, count(*) AS rows, CAST(sum(id) AS BIGINT) AS id_sum, true AS in_range, model
FROM units, (VALUES ('logistic'), ('random_forest')) m(model) GROUP BY treated, model""")
    S["feature_importance_shape"] = ("SELECT confounder, true AS is_share, CAST(1 AS DOUBLE) AS total FROM (VALUES ('acctbal'), ('n_orders'), "
                                     "('dose'), ('segment'), ('nation')) c(confounder)")
    S["matching_analysis_scored"] = S["treatment_effect"]
    S["ipw_analysis_scored"] = S["dose_response_bins"]
    S["preprocess_pipeline"] = q(*preprocess_sql(TARGET_VARIABLES))
    survey = analysis_ctes(TARGET_VARIABLES, 0.5)
    S["survey_interactions"] = q(survey, """SELECT id AS "_SEQNO", CAST(SEXVAR_AGE_INTERACTION AS INTEGER) AS "SEXVAR_AGE_INTERACTION",
  CAST(INCOME_EDUCA_INTERACTION AS INTEGER) AS "INCOME_EDUCA_INTERACTION",
  round(DISABILITY_EMPLOYMENT_INTERACTION, 6) AS "DISABILITY_EMPLOYMENT_INTERACTION" FROM inter""")
    matched = survey + ",\n" + pairs_cte("pairs", "ps", 0.05, 1, "sa") + ",\n" + cohort_cte("cohort", "pairs", "sa")
    S["survey_matching_scored"] = q(matched + ",\n" + balance_cte("ba", "cohort", [*NUMERIC, *LABELLED, "ps"]),
                                    "SELECT variable, round(treated_mean, 6) AS treated_mean, round(control_mean, 6) AS control_mean, "
                                    "round(smd, 6) AS smd FROM ba")
    S["survey_matching_effect"] = S["treatment_effect"].replace(_cohort_ctes(), matched)
    ctes, final = _spec_balance_sql({"minimal": ("ps", NUMERIC), "standard": ("ps_half", [*NUMERIC, *LABELLED])}, "sh")
    S["survey_spec_balance"] = q(survey + ",\nsh AS (SELECT *, ps / CAST(2 AS DOUBLE) AS ps_half FROM sa),\n" + ctes, final)
    S["survey_weighting_scored"] = q(survey + ",\nsw AS (SELECT sa.*, r.MENTHLTH_MAPPED AS y FROM sa JOIN r ON r._SEQNO = sa.id "
                                     "WHERE r.MENTHLTH_MAPPED IS NOT NULL),\n" + weighted_cte("w", "sw") + ",\n"
                                     + wls_sql("w", "y", "treated", "ipw_weight", "_EXERCISE_BINARY"), WLS_FINAL)
    S["nan_ingest"] = q("""u AS (SELECT id, n_orders, CASE WHEN id % 7 = 0 THEN NULL ELSE dose END AS dose FROM units),
m AS (SELECT min(dose) AS mn, max(dose) AS mx FROM u)""", """SELECT id, n_orders, dose,
       CASE WHEN dose > 0 THEN 1 ELSE 0 END AS flag, coalesce(dose, 0) + n_orders AS total,
       round((coalesce(dose, 0) + n_orders) / CASE WHEN dose IS NULL THEN 1 ELSE 2 END, 6) AS average,
       round((dose - mn) / (mx - mn), 6) AS "dose_NORMALIZED" FROM u, m""")
    S["blank_border"] = q("""c AS (SELECT id, 'level ' || CAST(scale5 AS VARCHAR) AS label FROM coded WHERE scale5 <> 3)""",
                          "SELECT id, label, 'memory' AS route FROM c UNION ALL SELECT id, label, 'file' AS route FROM c")
    S["wls_offset"] = q(weighted_cte() + ",\noff AS (SELECT *, dose + CAST(100000000 AS DOUBLE) AS dose_far FROM w),\n"
                        + wls_sql("off", "y", "dose_far", "ipw_weight", "dose_far"),
                        "SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(r2, 6) AS r_squared, n "
                        "FROM terms WHERE term = 'dose_far'")
    S["ipw_effect"] = q(weighted_cte() + ",\n" + wls_sql("w", "y", "treated", "ipw_weight", "treated"), WLS_FINAL)
    S["trend_line"] = q(weighted_cte() + ",\n" + wls_sql("w", "y", "dose", "ipw_weight", "dose") + """,
ab AS (SELECT max(CASE WHEN term = 'Intercept' THEN coef END) AS a, max(CASE WHEN term = 'dose' THEN coef END) AS b
       FROM terms),
ex AS (SELECT min(dose) AS mn, max(dose) AS mx FROM w),
pts AS (SELECT g.i AS point, CASE WHEN g.i = 99 THEN ex.mx ELSE g.i * ((ex.mx - ex.mn) / 99) + ex.mn END AS x
        FROM range(100) g(i), ex)""", "SELECT point, round(x, 6) AS x, round(a + b * x, 6) AS y_hat FROM pts, ab")
    S["preprocess_recodes"] = q(coded_recoded_cte() + f""",
pp AS (SELECT id, yesno_score, scale5_score, freq_weekly, duration_min, days30_mapped,
              CASE WHEN days30 BETWEEN 1 AND 30 THEN CAST(days30 AS DOUBLE) ELSE {D(0)} END / {D(30)} AS days30_or_zero,
              CASE WHEN weight IN (7777, 9999) THEN NULL ELSE weight END AS weight_clean,
              CASE COALESCE(part_a, part_b) WHEN 1 THEN {D(1)} WHEN 3 THEN {D(0.5)} ELSE {D(0)} END AS pair_score,
              ({fc}) / {D(3)} AS flag_index,
              COALESCE(TRY_CAST(scale5 AS INTEGER) IN (1, 2, 4, 5, 7), false) AS scale5_member,
              TRY_CAST(NULLIF(text_num, '') AS DOUBLE) AS text_value,
              {_severity()} AS severity,
              {row_sum(['yesno_score', 'scale5_score'])} AS score_total,
              {_weighted_index()} AS combo_index
       FROM cr)""", f"""SELECT id, yesno_score, scale5_score, freq_weekly, duration_min, days30_mapped, days30_or_zero,
  weight_clean, pair_score, flag_index, scale5_member, text_value, round(severity, 6) AS severity, score_total,
  round(combo_index, 6) AS combo_index,
  round({_minmax('score_total', 'sklearn')}, 6) AS score_total_normalized,
  round({_minmax('combo_index', 'zero')}, 6) AS combo_index_normalized,
  round({_minmax('severity', 'null')}, 6) AS severity_normalized
FROM pp""")
    S["subgroup_filter"] = q(_subgroup_sql(), "SELECT * FROM effects WHERE subgroup = 'Region'")
    # footer text: tags removed, entities decoded (the ones html.unescape meets in these pages), trimmed
    dec = "regexp_replace(f, '<[^>]*?>', '', 'g')"
    for ent, ch in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                    ("&#39;", "''"), ("&amp;", "&")):
        dec = f"replace({dec}, '{ent}', '{ch}')"
    S["footer_text"] = q("ft AS (SELECT page_id, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS f FROM pages)",
                         f"SELECT page_id, trim({dec}) AS footer FROM ft")
    S["stream_preprocess"] = S["preprocess_recodes"].replace(f"""round(combo_index, 6) AS combo_index,
  round({_minmax('score_total', 'sklearn')}, 6) AS score_total_normalized,
  round({_minmax('combo_index', 'zero')}, 6) AS combo_index_normalized,
  round({_minmax('severity', 'null')}, 6) AS severity_normalized
FROM pp""", "round(combo_index, 6) AS combo_index\nFROM pp")
    return S
