"""The survey stand-in (both forms) and an independent SQL form of its preprocessing.

The stand-in gives every survey column whole numbers of the size that its codes have, so that listed, unlisted and special
codes and NULL all occur; it does none of the recoding.  The SQL states the recodes by themselves, without the engine's tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: numbers below which a column's codes lie; 11 for the others
WIDE = {"ALCDAY4": 320, "AVEDRNK3": 100, "DRNK3GE5": 100, "MAXDRNKS": 100, "MENTHLTH": 100, "PHYSHLTH": 100, "POORHLTH": 100,
        "CHILDREN": 100, "MARIJAN1": 40, "PRIMINS1": 100, "STRENGTH": 900, "EXEROFT1": 320, "EXEROFT2": 320, "EXERHMM1": 1000,
        "EXERHMM2": 1000, "INCOME3": 13, "WEIGHT2": 10000, "HEIGHT3": 10000, "EXRACT12": 100, "EXRACT22": 100}


def survey_rows(orders: DataFrame, columns: list[str], id_col: str | None = None) -> DataFrame:
    """One row of survey codes per order; ``id_col``: the name of a column with the order's key."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(*[k.alias(n) for n in ([id_col] if id_col else [])], *[
        F.when((k * (j + 1) + c) % 13 != 0, (k * (2 * j + 3) + c * (j + 5)) % WIDE.get(name, 11)).cast("double").alias(name)
        for j, name in enumerate(columns)])


def survey_cte(columns: list[str]) -> str:
    parts = ",\n".join(
        f'CASE WHEN (o_orderkey * {j + 1} + o_custkey) % 13 <> 0 THEN CAST((o_orderkey * {2 * j + 3} + o_custkey * {j + 5}) '
        f'% {WIDE.get(name, 11)} AS DOUBLE) END AS "{name}"' for j, name in enumerate(columns))
    return f"survey AS (SELECT {parts} FROM orders)"


def _case(col: str, values: dict, kind=str) -> str:
    """CASE from {code: value}."""
    value = (lambda v: f"'{v}'") if kind is str else (lambda v: f"CAST({v} AS DOUBLE)")
    return f"CASE \"{col}\" " + " ".join(f"WHEN {code} THEN {value(v)}" for code, v in values.items()) + " END"


def _mean(parts: list[str], weights: list[float] | None = None) -> str:
    w = weights or [1.0] * len(parts)
    num = " + ".join(f"coalesce(({p}) * {x}::DOUBLE, 0)" for p, x in zip(parts, w))
    den = " + ".join(f"CASE WHEN ({p}) IS NULL THEN 0::DOUBLE ELSE {x}::DOUBLE END" for p, x in zip(parts, w))
    return f"(({num}) / nullif({den}, 0))"


# FIXED VALUES: the survey's codes, restated for the SQL
LABELS = {
    "SEXVAR": {1: "Male", 2: "Female"},
    "ADDEPEV3": {1: "Yes", 2: "No"},
    "VETERAN3": {1: "Yes", 2: "No"},
    "PREGNANT": {1: "Yes", 2: "No"},
    "RENTHOM1": {1: "Own", 2: "Rent", 3: "Other"},
    "MARITAL": {1: "Married", 2: "Divorced", 3: "Widowed", 4: "Separated", 5: "Never married",
                6: "A member of an unmarried couple"},
    "EDUCA": {1: "Never attended school or only kindergarten", 2: "Elementary", 3: "Some high school",
              4: "High school graduate", 5: "Some college/tech school", 6: "College graduate"},
    "EMPLOY1": {1: "Employed for wages", 2: "Self-employed", 3: "Out of work ≥1 year", 4: "Out of work <1 year",
                5: "Homemaker", 6: "Student", 7: "Retired", 8: "Unable to work"},
    "INCOME3": {1: "<$10k", 2: "$10k–15k", 3: "$15k–20k", 4: "$20k–25k", 5: "$25k–35k", 6: "$35k–50k", 7: "$50k–75k",
                8: "$75k–100k", 9: "$100k–150k", 10: "$150k–200k", 11: "$200k+"},
}
METRO = {1: "Metropolitan", 2: "Nonmetropolitan"}
URBAN = {1: "Urban", 2: "Rural"}
ACTIVITY = {1: "walking", 2: "running_jogging", 3: "gardening", 4: "bicycling", 5: "aerobics_class", 6: "calisthenics",
            7: "elliptical", 8: "household_activities", 9: "weight_lifting", 10: "yoga_pilates_tai_chi", 11: "other",
            88: "no_other_activity"}
ACE = {
    "ACEDEPRS": {1: 1, 2: 0},
    "ACEDRINK": {1: 1, 2: 0},
    "ACEDRUGS": {1: 1, 2: 0},
    "ACEPRISN": {1: 1, 2: 0},
    "ACEDIVRC": {1: 1, 2: 0},
    "ACEPUNCH": {1: 0, 2: 1, 3: 1},
    "ACEHURT1": {1: 0, 2: 1, 3: 1},
    "ACESWEAR": {1: 0, 2: 1, 3: 1},
    "ACETOUCH": {1: 0, 2: 1, 3: 1},
    "ACETTHEM": {1: 0, 2: 1, 3: 1},
    "ACEHVSEX": {1: 0, 2: 1, 3: 1},
    "ACEADSAF": {1: 0, 2: 0, 3: 0, 4: 1, 5: 1},
    "ACEADNED": {1: 0, 2: 0, 3: 0, 4: 1, 5: 1},
}
SMOKING = {
    "SMOKE100": {1: 1, 2: 0, 7: 0, 9: 0},
    "SMOKDAY2": {1: 1, 2: 0.5, 3: 0, 7: 0, 9: 0},
    "ECIGNOW2": {2: 1, 3: 0.5, 4: 0, 1: 0, 7: 0, 9: 0},
}
ACCESS = {
    "PRIMINS1": {1: 0.8, 2: 0.7, 3: 0.6, 4: 0.5, 5: 0.4, 6: 0.4, 7: 0.6, 8: 0.5, 9: 0.5, 10: 0.4, 88: 0.0},
    "PERSDOC3": {1: 1, 2: 1, 3: 0},
    "MEDCOST1": {1: 0, 2: 1},
    "CHECKUP1": {1: 1, 2: 0.8, 3: 0.5, 4: 0.2, 8: 0},
}
SOCIAL = {
    "FINANCIAL_INSECURITY": [("SDHBILLS", {1: 1, 2: 0}, 0.4), ("SDHUTILS", {1: 1, 2: 0}, 0.3), ("SDHTRNSP", {1: 1, 2: 0}, 0.3)],
    "FOOD_INSECURITY": [("FOODSTMP", {1: 1, 2: 0}, 0.5), ("SDHFOOD1", {1: 1, 2: 0.75, 3: 0.5, 4: 0.25, 5: 0}, 0.5)],
    "EMOTIONAL_DISTRESS": [
        ("LSATISFY", {1: 0, 2: 0.33, 3: 0.67, 4: 1}, 0.25),
        ("EMTSUPRT", {1: 0, 2: 0.25, 3: 0.5, 4: 0.75, 5: 1}, 0.25),
        ("SDLONELY", {1: 1, 2: 0.75, 3: 0.5, 4: 0.25, 5: 0}, 0.25),
        ("SDHSTRE1", {1: 1, 2: 0.75, 3: 0.5, 4: 0.25, 5: 0}, 0.25)],
    "FACING_UNEMPLOYMENT": [("SDHEMPLY", {1: 1, 2: 0}, 1.0)],
}
#: calipers and ratios of the specification test, in its order
SETTINGS = [(0.05, 1), (0.1, 1), (0.1, 2), (0.15, 1)]
# ---- end of fixed values


def preprocess_sql(columns: list[str]) -> tuple[str, str]:
    """(CTEs, final SELECT) of the 12 recode groups over ``survey``, doubles rounded to 6 places."""
    def weekly(c, never=False):
        return (f"CASE WHEN {c} BETWEEN 101 AND 199 THEN {c} - 100 WHEN {c} BETWEEN 201 AND 299 THEN ({c} - 200) / 4.345::DOUBLE"
                + (f" WHEN {c} = 888 THEN 0" if never else "") + " END")

    def minutes(c):
        return f"CASE WHEN {c} BETWEEN 1 AND 759 THEN {c} WHEN {c} BETWEEN 800 AND 959 THEN ({c} - 800) * 60 END"

    alcohol = [f"CASE WHEN ALCDAY4 BETWEEN 101 AND 199 THEN (ALCDAY4 - 100) / 30 WHEN ALCDAY4 BETWEEN 201 AND 299 "
               f"THEN (ALCDAY4 - 200) / 4.3::DOUBLE / 30 END"]
    alcohol += [f"CASE WHEN {c} BETWEEN 1 AND 76 THEN {c} / {d} END" for c, d in (("AVEDRNK3", 15), ("DRNK3GE5", 30), ("MAXDRNKS", 15))]
    disabled = " + ".join(f"CASE WHEN {c} = 1 THEN 1 ELSE 0 END" for c in ("DEAF", "BLIND", "DECIDE", "DIFFWALK", "DIFFDRES", "DIFFALON"))
    new = {c: _case(c, m) for c, m in LABELS.items()}
    new["CHILDREN"] = "CASE WHEN CHILDREN BETWEEN 1 AND 87 THEN CAST(CAST(CHILDREN AS BIGINT) AS VARCHAR) END"
    new |= {c: f"CASE WHEN {c} NOT IN (7777, 9999) THEN {c} END" for c in ("WEIGHT2", "HEIGHT3")}
    new["ACE_TOTAL"] = " + ".join(f"coalesce({_case(c, m, float)}, 0)" for c, m in ACE.items())
    new["ALCOHOL_SEVERITY"] = _mean(alcohol)
    new |= {"DISABILITY_INDEX": f"({disabled})", "DISABILITY_INDEX_NORMALIZED": f"({disabled}) / 6::DOUBLE"}
    new |= {"METRO_AREA": _case("_METSTAT", METRO), "URBAN_RURAL_AREA": _case("_URBSTAT", URBAN)}
    new["SMOKING_INDEX"] = _mean([_case(c, m, float) for c, m in SMOKING.items()])
    new["MARIJUANA_INDEX_NORMALIZED"] = "CASE WHEN MARIJAN1 BETWEEN 1 AND 30 THEN MARIJAN1 ELSE 0 END / 30::DOUBLE"
    new["SEXUAL_ORIENTATION_SCORE"] = "CASE coalesce(SOMALE, SOFEMALE) WHEN 1 THEN 1::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0::DOUBLE END"
    new |= {f"{n}_INDEX": _mean([_case(c, m, float) for c, m, _ in p], [w for *_, w in p]) for n, p in SOCIAL.items()}
    new["HEALTHCAREACCESS_INDEX_WEIGHTED"] = _mean([_case(c, m, float) for c, m in ACCESS.items()], [0.25] * 4)
    new["MENTHLTH_MAPPED"] = "CASE WHEN MENTHLTH BETWEEN 1 AND 30 THEN MENTHLTH / 30 END"
    new |= {"STRENGTH_WEEKLY": weekly("STRENGTH", True), "EXEROFT1_WEEKLY": weekly("EXEROFT1"), "EXEROFT2_WEEKLY": weekly("EXEROFT2")}
    for c in ("EXRACT12", "EXRACT22"):
        new |= {f"{c}_ACTIVITY": _case(c, ACTIVITY), f"{c}_AEROBIC": f"coalesce({c} IN (1, 2, 4, 5, 7), false)"}
    new |= {f"{c}_MIN": minutes(c) for c in ("EXERHMM1", "EXERHMM2")}
    ctes = survey_cte(columns) + ",\nr AS (SELECT " + ",\n".join(f'{e} AS "{n}"' for n, e in new.items()) + " FROM survey)"
    scaled = {"ACE_TOTAL": "ACE_NORMALIZED", "ALCOHOL_SEVERITY": "ALCOHOL_SEVERITY_NORMALIZED", "SMOKING_INDEX": "SMOKING_INDEX_NORMALIZED",
              "HEALTHCAREACCESS_INDEX_WEIGHTED": "HEALTHCAREACCESS_INDEX_NORMALIZED", **{f"{n}_INDEX": f"{n}_INDEX_NORMALIZED" for n in SOCIAL}}
    doubles = {n for n in new if n.endswith(("_NORMALIZED", "_SEVERITY", "_WEIGHTED", "_SCORE", "_MAPPED", "_WEEKLY", "_MIN", "_TOTAL"))
               or n.endswith("_INDEX") and n != "DISABILITY_INDEX"}
    out = [f'round("{n}", 6) AS "{n}"' if n in doubles else f'"{n}"' for n in new]
    out += [f'round(("{a}" - min("{a}") OVER ()) / (max("{a}") OVER () - min("{a}") OVER ()), 6) AS "{b}"' for a, b in scaled.items()]
    return ctes, "SELECT " + ", ".join(out) + " FROM r"


#: Confounders, most of them complete, for the analyses of the stand-in; the labelled ones are coded.
NUMERIC = ["ACE_NORMALIZED", "DISABILITY_INDEX_NORMALIZED", "MARIJUANA_INDEX_NORMALIZED", "SEXUAL_ORIENTATION_SCORE"]
LABELLED = ["MARITAL", "EMPLOY1"]


def analysis_ctes(columns: list[str], threshold: float) -> str:
    """CTEs up to ``sa``: id, treated, outcome, NUMERIC and coded LABELLED of complete cases, the interactions, and the score ps."""
    ctes, _ = preprocess_sql(columns)
    ctes = ctes.replace("survey AS (SELECT ", 'survey AS (SELECT o_orderkey AS "_SEQNO", ', 1).replace(
        "r AS (SELECT ", 'r AS (SELECT "_SEQNO", ', 1)
    codes = ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}" for c in LABELLED)
    everywhere = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 AS DOUBLE) END AS {c}_n"
                           for c in ("SEXVAR", "INCOME3", "EDUCA", "EMPLOY1"))
    return ctes + f""",
r2 AS (SELECT *, (ACE_TOTAL - min(ACE_TOTAL) OVER ()) / (max(ACE_TOTAL) OVER () - min(ACE_TOTAL) OVER ()) AS ACE_NORMALIZED FROM r),
sx AS (SELECT "_SEQNO" AS id, {everywhere}, DISABILITY_INDEX_NORMALIZED AS dis FROM r),
inter AS (SELECT id, SEXVAR_n * 50 AS SEXVAR_AGE_INTERACTION, INCOME3_n * EDUCA_n AS INCOME_EDUCA_INTERACTION,
                 dis * EMPLOY1_n AS DISABILITY_EMPLOYMENT_INTERACTION FROM sx),
sc AS (SELECT "_SEQNO" AS id, CASE WHEN STRENGTH_WEEKLY > 0 OR EXEROFT1_WEEKLY > 0 OR EXEROFT2_WEEKLY > 0 THEN 1 ELSE 0 END AS treated,
              CASE WHEN MENTHLTH_MAPPED <= {threshold} THEN 1 ELSE 0 END AS outcome, {", ".join(NUMERIC + LABELLED)} FROM r2
       WHERE {" AND ".join(f"{c} IS NOT NULL" for c in NUMERIC + LABELLED)}),
sa AS (SELECT id, treated, outcome, {", ".join(NUMERIC)}, {codes}, ({" + ".join(NUMERIC)}) / 4::DOUBLE AS ps FROM sc)"""
