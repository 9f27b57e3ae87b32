"""Code, name and label scalars (X1-X8, X11, X13) as Column expressions.

Lookups are literal maps / ``when`` chains evaluated inside whole-stage
codegen -- no Python UDF.  Regexes use ``(?iU)``: case-insensitive with
Unicode case folding and Unicode ``\\b``/``\\s`` (``(?i)`` alone would miss
``bedøvelse`` vs ``BEDØVELSE``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the source pipeline's tables for equal results)
# ---------------------------------------------------------------------------
# Vital sign parameter names -> feature
VITALS_MAP = {
    "Saturation": "SPO2",
    "ABP Puls (fra A-kanyle)": "HR",
    "Puls": "HR",
    "Puls (fra SAT-måler)": "HR",
    "Resp.frekvens": "RESPIRATORYRATE",
    "SYSTOLIC": "SBP",
    "ART mean inv BT": "MAP",
    "Temp (in Celsius)": "TEMP",
    "Temp.": "TEMP",
    "DBP": "DBP",
    "SBP": "SBP",
}
# Blood pressure parameters holding "sys/dia" text
BP_TYPES = [
    "BT",
    "ART inv BT",
    "Invasivt BT - ABP (sys/dia)",
    "NIBP",
    "ABP inv BT",
    "Invasivt BT - ART (sys/dia)",
]
HEIGHT_WEIGHT_MAP = {"Højde": "HEIGHT", "Vægt": "WEIGHT"}
# Lab feature -> raw test names
LABS_FEATURE_MAP = {
    "LACTATE": ("LAKTAT(POC);P(AB)", "LAKTAT;P(AB)", "LAKTAT;P(VB)", "LAKTAT(POC);P(VB)",
                "LAKTAT;CSV", "LAKTAT(POC);CSV", "LAKTAT(POC);P(KB)"),
    "BASE_EXCESS": ("BASE EXCESS;ECV", "ECV-BASE EXCESS;(POC)"),
    "HEMOGLOBIN": ("HÆMOGLOBIN;B", "HÆMOGLOBIN(POC);B", "HÆMOGLOBIN (POC);B"),
    "LEUKOCYTES": ("LEUKOCYTTER;B",),
    "B-GROUP-LEUKOCYTES": ("LEUKOCYTTYPE (MIKR.) GRUPPE;B", "LEUKOCYTTYPE GRUPPE;B",
                           "LEUKOCYTTYPE; ANTALK. (LISTE);B"),
    "TEG-R": ("TEG-R",),
    "TEG-MA": ("TEG-MA",),
    "TEG-LY30": ("TEG-LY30",),
}
ICU_MAP = {
    "GLASGOW COMA SCORE": "GCS",
    "Glasgow Coma Score": "GCS",
    "SAPS 3 SCORE": "SAPS3",
    "SOFA total score": "SOFA",
}
# Medication category -> ATC prefixes (level 3, then level 4)
ATC_LVL3_MAP = {
    "cardiovascular_drugs": ["C01", "C02", "C07"],
    "antibiotics": ["J01"],
    "neuro_drugs": ["N05", "M03"],
    "anti_thrombotic": ["B01"],
    "diuretics": ["C03"],
    "hemostatics": ["B02"],
}
ATC_LVL4_MAP = {
    "infusion": ["B05B", "B05X"],
    "blood": ["B05A"],
    "opiods": ["N02A"],
    "local_anastethics": ["N01B"],
    "anastethics": ["N01A"],
    "insulin": ["A10A"],
}
MEDICATION_ACTION_LIST = [
    "Administreret",
    "Ny pose",
    "Selvadministration",
    "Adm. ernæring/sterilt vand",
    "Genstartet",
    "Infusion/pose skiftet",
    "Selvmedicinering",
    "Status, indgift",
]
# Department classes in priority order; a tuple means all must match
ADT_RULES: list[tuple[str, list]] = [
    ("TC", ["traumecenter"]),
    ("OR", [
        "operationsgang",
        "operationsklinik",
        "operationsafsnit",
        "dagkirurgi",
        "op afs",
        "op-afsnit",
        "centraloperation",
        "operationsanæstesi",
        r"\bBEDØVELSE OG OPERATION\b",
        ("øjenkl", "operation"),
        r"\bREUM/RYG OP\b",
        "kirurgisk endo",
    ]),
    ("ICU", [r"\bintensiv\b", r"\bita\s", r"\bita,"]),
    ("BED", ["seng"]),
    ("AMB", ["amb"]),
]
VALID_HOSPITALS = [
    "RH", "AHH", "HGH", "NOH", "BFH", "BOH", "RHP",
    "SJ KØGE", "SJ HOLBÆK", "SJ NYKØBING", "SJ ROSKILDE",
    "SJ VORDINGBORG", "SJ NÆSTVED", "SJ SLAGELSE",
]
SEX_MAP = {"Mand": "Male", "Kvinde": "Female", "M": "Male", "F": "Female", "K": "Female",
           "Male": "Male", "Female": "Female"}
# Site marker for "first contact at the trauma centre" (A9)
SITE_PATTERN = "RH "


def invert(mapping: Mapping[str, Sequence[str]]) -> dict[str, str]:
    return {code: name for name, codes in mapping.items() for code in codes}


LABS_REVERSE_MAP = invert(LABS_FEATURE_MAP)
ATC_LVL3_REVERSE = invert(ATC_LVL3_MAP)
ATC_LVL4_REVERSE = invert(ATC_LVL4_MAP)


def map_lit(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def recode(c: Column, mapping: Mapping[str, str]) -> Column:
    """Dictionary recode; unmapped values kept."""
    if not mapping:
        return c
    return F.coalesce(map_lit(mapping)[c], c)


def lookup(c: Column, mapping: Mapping[str, str]) -> Column:
    """Dictionary lookup; unmapped -> null."""
    if not mapping:
        return F.lit(None).cast("string")
    return map_lit(mapping)[c]


def _rx(p: str) -> str:
    return "(?iU)" + p


def classify(c: Column, rules: list[tuple[str, list]] = ADT_RULES) -> Column:
    """Ordered regex classes, first hit wins; tuples need every part;
    null/empty -> null."""
    expr = None
    for label, pats in rules:
        simple = [p for p in pats if isinstance(p, str)]
        conds = []
        if simple:
            conds.append(c.rlike(_rx("(?:" + "|".join(simple) + ")")))
        for p in pats:
            if isinstance(p, tuple):
                cond = None
                for q in p:
                    cond = c.rlike(_rx(q)) if cond is None else cond & c.rlike(_rx(q))
                conds.append(cond)
        any_cond = conds[0]
        for x in conds[1:]:
            any_cond = any_cond | x
        expr = F.when(any_cond, F.lit(label)) if expr is None else expr.when(any_cond, F.lit(label))
    return F.when(c.isNotNull() & (c != ""), expr)


def _strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_hospital(c: Column) -> Column:
    """First word; ``SJ x`` keeps two words (case-sensitive SJ)."""
    words = F.split(_strip_ws(c), r"\s+")
    return F.when(c.isNull(), F.lit(None).cast("string")) \
            .when(words[0] == "SJ", F.array_join(F.slice(words, 1, 2), " ")) \
            .otherwise(words[0])


def standardize_hospital(c: Column, valid: Sequence[str] = VALID_HOSPITALS) -> Column:
    """Upper-case; ``SJ HOL*`` / ``SJ ROS*``; exact valid names; else MISC."""
    u = F.upper(_strip_ws(c))
    canon = {v.upper(): v for v in valid}
    return F.when(c.isNull(), F.lit(None).cast("string")) \
            .when(u.startswith("SJ HOL"), "SJ HOLBÆK") \
            .when(u.startswith("SJ ROS"), "SJ ROSKILDE") \
            .otherwise(F.coalesce(map_lit(canon)[u], F.lit("MISC")))


def derive_first_hospital(c: Column, empty_is_null: bool = True) -> Column:
    """Comma removal -> X2 -> X3.  ``empty_is_null`` (scalar form) maps
    an empty name to null; the frame form maps it to MISC."""
    cleaned = F.regexp_replace(c, ",", "")
    out = standardize_hospital(first_hospital(cleaned))
    if empty_is_null:
        return F.when(c.isNotNull() & (_strip_ws(c) != ""), out)
    return out


def classify_atc(c: Column) -> Column:
    """Level-3 category, else level-4 category, else null."""
    return F.coalesce(lookup(F.substring(c, 1, 3), ATC_LVL3_REVERSE),
                      lookup(F.substring(c, 1, 4), ATC_LVL4_REVERSE))


def normalize_sex(c: Column) -> Column:
    """X8 (recode keeps unknown values)."""
    return recode(c, SEX_MAP)


def strip_code_ends(c: Column) -> Column:
    """X11: drop the first and last character (``DC221A`` -> ``C221``)."""
    return F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))


def hours_label(minutes: Column) -> Column:
    """X13 short label: ``6.0h`` below a day, else ``2.5d``; null -> N/A.
    One decimal, half-to-even (``6.25`` -> ``6.2``)."""
    h = minutes / 60.0
    return F.when(minutes.isNull(), F.lit("N/A")) \
            .when(h < 24, F.concat(F.format_string("%.1f", F.bround(h, 1)), F.lit("h"))) \
            .otherwise(F.concat(F.format_string("%.1f", F.bround(h / 24.0, 1)), F.lit("d")))


def _num_text(x: Column) -> Column:
    # integral values print without decimals, others as the shortest text
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def step_label(minutes: Column, step: Column) -> Column:
    """X13 long label: ``5 min`` / ``6 h`` / ``1 day`` / ``3 days``;
    ``Step n`` when the step has no time."""
    h = minutes / 60.0
    d = minutes / 1440.0
    return F.when(minutes.isNull(), F.concat(F.lit("Step "), step.cast("string"))) \
            .when(minutes < 60, F.concat(minutes.cast("bigint").cast("string"), F.lit(" min"))) \
            .when(minutes < 1440, F.concat(_num_text(h), F.lit(" h"))) \
            .otherwise(F.concat(_num_text(d), F.when(d == 1, F.lit(" day")).otherwise(F.lit(" days"))))
