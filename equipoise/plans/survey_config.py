"""Survey recode configuration.

FIXED VALUES: the code dictionaries, weights, variable lists and constants
below must equal the reference's for the same results on the survey extract.
They are stated as given there, in their natural order.
"""

from __future__ import annotations

# ---- FIXED VALUES (survey codes) -------------------------------------------------

TARGET_VARIABLES = [
    "SEXVAR", "PHYSHLTH", "MENTHLTH", "POORHLTH", "PRIMINS1", "PERSDOC3",
    "MEDCOST1", "CHECKUP1", "EXERANY2", "EXRACT12", "EXEROFT1", "EXERHMM1",
    "EXRACT22", "EXEROFT2", "EXERHMM2", "STRENGTH", "ADDEPEV3", "MARITAL",
    "EDUCA", "RENTHOM1", "VETERAN3", "EMPLOY1", "CHILDREN", "INCOME3",
    "PREGNANT", "WEIGHT2", "HEIGHT3", "DEAF", "BLIND", "DECIDE", "DIFFWALK",
    "DIFFDRES", "DIFFALON", "SMOKE100", "SMOKDAY2", "ECIGNOW2", "ALCDAY4",
    "AVEDRNK3", "DRNK3GE5", "MAXDRNKS", "SOMALE", "SOFEMALE", "MARIJAN1",
    "ACEDEPRS", "ACEDRINK", "ACEDRUGS", "ACEPRISN", "ACEDIVRC", "ACEPUNCH",
    "ACEHURT1", "ACESWEAR", "ACETOUCH", "ACETTHEM", "ACEHVSEX", "ACEADSAF",
    "ACEADNED", "LSATISFY", "EMTSUPRT", "SDLONELY", "SDHEMPLY", "FOODSTMP",
    "SDHFOOD1", "SDHBILLS", "SDHUTILS", "SDHTRNSP", "SDHSTRE1", "_METSTAT", "_URBSTAT",
]

SECTIONS_OF_INTEREST = [
    "adversechildhoodexperiences", "alcoholconsumption", "chronichealthconditions",
    "demographics", "disability", "healthcareaccess", "healthydays",
    "marijuanause", "othertobaccouse", "respondentsex", "sexualorientation",
    "socialdeterminants", "tobaccouse", "urbanrural", "exercise",
]

ACE_MAPS = {
    "ACEDEPRS": {1: 1, 2: 0, 7: None, 9: None},
    "ACEDRINK": {1: 1, 2: 0, 7: None, 9: None},
    "ACEDRUGS": {1: 1, 2: 0, 7: None, 9: None},
    "ACEPRISN": {1: 1, 2: 0, 7: None, 9: None},
    "ACEDIVRC": {1: 1, 2: 0, 7: None, 8: None, 9: None},
    "ACEPUNCH": {1: 0, 2: 1, 3: 1, 7: None, 9: None},
    "ACEHURT1": {1: 0, 2: 1, 3: 1, 7: None, 9: None},
    "ACESWEAR": {1: 0, 2: 1, 3: 1, 7: None, 9: None},
    "ACETOUCH": {1: 0, 2: 1, 3: 1, 7: None, 9: None},
    "ACETTHEM": {1: 0, 2: 1, 3: 1, 7: None, 9: None},
    "ACEHVSEX": {1: 0, 2: 1, 3: 1, 7: None, 9: None},
    "ACEADSAF": {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 7: None, 9: None},
    "ACEADNED": {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 7: None, 9: None},
}

# alcohol severity: frequency 1xx weekly / 2xx monthly (4.3 weeks per month), each part scaled to 0-1
ALCOHOL_WEEKS_PER_MONTH = 4.3
ALCOHOL_FREQ_DIVISOR = 30
ALCOHOL_PARTS = {"AVEDRNK3": (1, 76, 15), "DRNK3GE5": (1, 76, 30), "MAXDRNKS": (1, 76, 15)}

LABEL_MAPS = {
    "SEXVAR": {1: "Male", 2: "Female"},
    "MARITAL": {1: "Married", 2: "Divorced", 3: "Widowed", 4: "Separated",
                5: "Never married", 6: "A member of an unmarried couple", 9: None},
    "EDUCA": {1: "Never attended school or only kindergarten", 2: "Elementary", 3: "Some high school",
              4: "High school graduate", 5: "Some college/tech school", 6: "College graduate", 9: None},
    "RENTHOM1": {1: "Own", 2: "Rent", 3: "Other", 7: None, 9: None},
    "VETERAN3": {1: "Yes", 2: "No", 7: None, 9: None},
    "EMPLOY1": {1: "Employed for wages", 2: "Self-employed", 3: "Out of work ≥1 year",
                4: "Out of work <1 year", 5: "Homemaker", 6: "Student", 7: "Retired",
                8: "Unable to work", 9: None},
    "INCOME3": {1: "<$10k", 2: "$10k–15k", 3: "$15k–20k", 4: "$20k–25k", 5: "$25k–35k", 6: "$35k–50k",
                7: "$50k–75k", 8: "$75k–100k", 9: "$100k–150k", 10: "$150k–200k", 11: "$200k+",
                77: None, 99: None},
    "PREGNANT": {1: "Yes", 2: "No", 7: None, 9: None},
    "ADDEPEV3": {1: "Yes", 2: "No", 7: None, 9: None},
}
# CHILDREN: codes 1..87 keep their number as text, 88 -> "" (none), 99 -> missing
CHILDREN_RANGE = (1, 87)
CHILDREN_EXTRA = {88: "", 99: None}
WEIGHT_HEIGHT_SPECIAL = [7777, 9999]

DISABILITY_VARS = ["DEAF", "BLIND", "DECIDE", "DIFFWALK", "DIFFDRES", "DIFFALON"]

GEO_MAPS = {
    "METRO_AREA": ("_METSTAT", {1: "Metropolitan", 2: "Nonmetropolitan"}),
    "URBAN_RURAL_AREA": ("_URBSTAT", {1: "Urban", 2: "Rural"}),
}

SMOKING_MAPS = {
    "SMOKE100": {1: 1, 2: 0, 7: 0, 9: 0},
    "SMOKDAY2": {1: 1, 2: 0.5, 3: 0, 7: 0, 9: 0},
    "ECIGNOW2": {2: 1, 3: 0.5, 4: 0, 1: 0, 7: 0, 9: 0},
}
MARIJUANA_DAYS = (1, 30)

ORIENTATION_MAP = {1: 1, 3: 0.5}  # every other answer (2, 4, 7, 9, missing) scores 0

SATISFACTION_MAP = {1: 0, 2: 0.33, 3: 0.67, 4: 1, 7: None, 9: None}
EMOTIONAL_SUPPORT_MAP = {1: 0, 2: 0.25, 3: 0.5, 4: 0.75, 5: 1, 7: None, 9: None}
LONELY_MAP = {1: 1, 2: 0.75, 3: 0.5, 4: 0.25, 5: 0, 7: None, 9: None}
EMPLOYMENT_LOSS_MAP = {1: 1, 2: 0, 7: None, 9: None}
FOOD_STAMPS_MAP = {1: 1, 2: 0, 7: None, 9: None}
FOOD_INSECURITY_MAP = {1: 1, 2: 0.75, 3: 0.5, 4: 0.25, 5: 0, 7: None, 9: None}
BILLS_MAP = {1: 1, 2: 0, 7: None, 9: None}
SOCIAL_MAPS = {
    "LSATISFY": SATISFACTION_MAP,
    "EMTSUPRT": EMOTIONAL_SUPPORT_MAP,
    "SDLONELY": LONELY_MAP,
    "SDHEMPLY": EMPLOYMENT_LOSS_MAP,
    "FOODSTMP": FOOD_STAMPS_MAP,
    "SDHFOOD1": FOOD_INSECURITY_MAP,
    "SDHBILLS": BILLS_MAP,
    "SDHUTILS": BILLS_MAP,
    "SDHTRNSP": BILLS_MAP,
    "SDHSTRE1": FOOD_INSECURITY_MAP,
}
SOCIAL_INDEX_WEIGHTS = {
    "financial_insecurity": {"SDHBILLS": 0.4, "SDHUTILS": 0.3, "SDHTRNSP": 0.3},
    "food_insecurity": {"FOODSTMP": 0.5, "SDHFOOD1": 0.5},
    "emotional_distress": {"LSATISFY": 0.25, "EMTSUPRT": 0.25, "SDLONELY": 0.25, "SDHSTRE1": 0.25},
    "facing_unemployment": {"SDHEMPLY": 1.0},
}

ACCESS_MAPS = {
    "PRIMINS1": {1: 0.8, 2: 0.7, 3: 0.6, 4: 0.5, 5: 0.4, 6: 0.4, 7: 0.6, 8: 0.5, 9: 0.5, 10: 0.4,
                 88: 0.0, 77: None, 99: None},
    "PERSDOC3": {1: 1.0, 2: 1.0, 3: 0.0, 7: None, 9: None},
    "MEDCOST1": {1: 0.0, 2: 1.0, 7: None, 9: None},
    "CHECKUP1": {1: 1.0, 2: 0.8, 3: 0.5, 4: 0.2, 7: None, 8: 0.0, 9: None},
}
ACCESS_WEIGHTS = {"PRIMINS1": 0.25, "PERSDOC3": 0.25, "MEDCOST1": 0.25, "CHECKUP1": 0.25}

MENTAL_SPECIAL = [77, 88, 99]
MENTAL_TOP = 30

EXERCISE_WEEKS_PER_MONTH = 4.345
STRENGTH_NEVER_CODE = 888
ACTIVITY_MAP = {
    1: "walking", 2: "running_jogging", 3: "gardening", 4: "bicycling",
    5: "aerobics_class", 6: "calisthenics", 7: "elliptical",
    8: "household_activities", 9: "weight_lifting", 10: "yoga_pilates_tai_chi",
    11: "other", 77: None, 88: "no_other_activity", 99: None,
}
AEROBIC_CODES = [1, 2, 4, 5, 7]

DROP_COLUMNS = [
    "ACEDEPRS", "ACEDRINK", "ACEDRUGS", "ACEPRISN", "ACEDIVRC", "ACEPUNCH",
    "ACEHURT1", "ACESWEAR", "ACETOUCH", "ACETTHEM", "ACEHVSEX", "ACEADSAF", "ACEADNED",
    "ALCDAY4", "AVEDRNK3", "DRNK3GE5", "MAXDRNKS",
    "DEAF", "BLIND", "DECIDE", "DIFFWALK", "DIFFDRES", "DIFFALON",
    "_METSTAT", "_URBSTAT",
    "SMOKE100", "SMOKDAY2", "ECIGNOW2",
    "MARIJAN1",
    "SOMALE", "SOFEMALE",
    "LSATISFY", "EMTSUPRT", "SDLONELY", "SDHEMPLY", "FOODSTMP",
    "SDHFOOD1", "SDHBILLS", "SDHUTILS", "SDHTRNSP", "SDHSTRE1",
    "PRIMINS1", "PERSDOC3", "MEDCOST1", "CHECKUP1",
    "PHYSHLTH", "MENTHLTH", "POORHLTH",
    "EXERANY2", "EXRACT12", "EXEROFT1", "EXERHMM1", "EXRACT22", "EXEROFT2", "EXERHMM2", "STRENGTH",
    "DEAF_label", "BLIND_label", "DECIDE_label", "DIFFWALK_label", "DIFFDRES_label", "DIFFALON_label",
    "DEAF_bin", "BLIND_bin", "DECIDE_bin", "DIFFWALK_bin", "DIFFDRES_bin", "DIFFALON_bin",
]

# analysis: treatment / outcome definitions and confounder sets
TREATMENT_PARTS = ["STRENGTH_WEEKLY", "EXEROFT1_WEEKLY", "EXEROFT2_WEEKLY"]
OUTCOME_SOURCE = "MENTHLTH_MAPPED"
OUTCOME_THRESHOLD = 0.5
CATEGORICAL_VARS = ["SEXVAR", "MARITAL", "EDUCA", "RENTHOM1", "VETERAN3", "EMPLOY1", "CHILDREN", "INCOME3",
                    "PREGNANT", "METRO_AREA", "URBAN_RURAL_AREA", "ADDEPEV3"]
FULL_MODEL = [
    "SEXVAR", "MARITAL", "EDUCA", "INCOME3", "EMPLOY1", "ADDEPEV3",
    "DISABILITY_INDEX_NORMALIZED", "WEIGHT2", "HEIGHT3", "CHILDREN",
    "ALCOHOL_SEVERITY_NORMALIZED", "SMOKING_INDEX_NORMALIZED",
    "MARIJUANA_INDEX_NORMALIZED", "FINANCIAL_INSECURITY_INDEX_NORMALIZED",
    "FOOD_INSECURITY_INDEX_NORMALIZED", "EMOTIONAL_DISTRESS_INDEX_NORMALIZED",
    "FACING_UNEMPLOYMENT_INDEX_NORMALIZED", "HEALTHCAREACCESS_INDEX_NORMALIZED",
    "METRO_AREA", "URBAN_RURAL_AREA", "ACE_NORMALIZED",
    "SEXUAL_ORIENTATION_SCORE", "VETERAN3", "RENTHOM1", "PREGNANT",
]
BASE_CONFOUNDERS = ["SEXVAR", "MARITAL", "EDUCA", "INCOME3", "EMPLOY1", "ADDEPEV3", "DISABILITY_INDEX_NORMALIZED"]
SPEC_ADDITIONS = [
    ("minimal", ["WEIGHT2", "HEIGHT3", "CHILDREN"]),
    ("standard", ["ALCOHOL_SEVERITY_NORMALIZED", "SMOKING_INDEX_NORMALIZED", "MARIJUANA_INDEX_NORMALIZED"]),
    ("comprehensive", ["FINANCIAL_INSECURITY_INDEX_NORMALIZED", "FOOD_INSECURITY_INDEX_NORMALIZED",
                       "EMOTIONAL_DISTRESS_INDEX_NORMALIZED", "FACING_UNEMPLOYMENT_INDEX_NORMALIZED",
                       "HEALTHCAREACCESS_INDEX_NORMALIZED"]),
    ("extended", ["METRO_AREA", "URBAN_RURAL_AREA", "ACE_NORMALIZED", "SEXUAL_ORIENTATION_SCORE",
                  "VETERAN3", "RENTHOM1"]),
    ("enhanced_interactions", ["SEXVAR_AGE_INTERACTION", "INCOME_EDUCA_INTERACTION",
                               "DISABILITY_EMPLOYMENT_INTERACTION"]),
]
AGE_PROXY = 50
INTERACTION_CATEGORIES = ["SEXVAR", "MARITAL", "EDUCA", "RENTHOM1", "VETERAN3", "EMPLOY1", "CHILDREN", "INCOME3", "PREGNANT",
                          "METRO_AREA", "URBAN_RURAL_AREA", "ADDEPEV3"]
INTERACTIONS = {
    "SEXVAR_AGE_INTERACTION": ("SEXVAR_NUMERIC", AGE_PROXY),
    "INCOME_EDUCA_INTERACTION": ("INCOME3_NUMERIC", "EDUCA_NUMERIC"),
    "DISABILITY_EMPLOYMENT_INTERACTION": ("DISABILITY_INDEX_NORMALIZED", "EMPLOY1_NUMERIC"),
}
SPEC_GRID = [(0.05, 1), (0.1, 1), (0.1, 2), (0.15, 1)]  # (caliper, ratio), all "nearest"
MAIN_CALIPER = 0.05
MAIN_RATIO = 1
RF_MAIN = {"num_trees": 100, "max_depth": 5, "seed": 42}
RF_WEIGHTING = {"num_trees": 50, "max_depth": 5, "min_instances_per_node": 10, "seed": 42}
DOSE_BIN_WIDTH = 60
EXERCISE_CATEGORY_EDGES = [-1, 0, 2, 4, 7]
EXERCISE_CATEGORY_LABELS = ["None", "Low", "Moderate", "High"]
MENTAL_CATEGORY_EDGES = [0, 0.3, 0.6, 1.0]
BASELINE_LABELS = ["Poor", "Fair", "Good"]
SUBGROUPS = {
    "Gender": "SEXVAR", "Income": "INCOME3", "Education": "EDUCA", "Marital Status": "MARITAL",
    "Employment Status": "EMPLOY1", "Veteran Status": "VETERAN3", "Urban/Rural Area": "URBAN_RURAL_AREA",
}
MIN_SUBGROUP_SIZE = 50
MIN_BIN_COUNT = 10
TOP_BINS = 20

# ---- end of fixed values ---------------------------------------------------------


def spec_sets() -> dict:
    """The six confounder sets of the specification grid (each builds on the previous)."""
    specs = {}
    current = list(BASE_CONFOUNDERS)
    for name, extra in SPEC_ADDITIONS:
        current = current + extra
        specs[name] = list(current)
    specs["full_model"] = list(FULL_MODEL)
    return specs
