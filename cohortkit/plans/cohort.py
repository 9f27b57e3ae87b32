"""Cohort jobs (K1-K13, K22): population -> trajectories -> matched,
enriched, numbered base table with static features and targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.numeric import numeric_or_null
from ..functions.timefns import age_years, days_between, event_within_days, shift_where, ts_column
from ..operators.filters import fill_window_from_date, prefix_filter
from ..operators.joins import (anti_reappend, left_join_unique, lookback_join, match_trajectories,
                               nearest_in_time, pair_start_end, window_join)
from ..operators.ordered import dense_rank_global, ordered_scan, range_buckets
from ..operators.reshape import numbered_collection
from ..operators.trajectories import build_trajectories, overlap_with_next
from ..session import cut_lineage, worked_out_once

# The surgical seed code prefix and the diagnosis codes kept
# for the wide diagnosis columns.
POPULATION_PREFIX = "KJJ"
DIAGNOSIS_INCLUSION = [
    "DC220", "DC227", "DC229", "DC221", "DC221A", "DC239",
    "DC240", "DC240A", "DC240B", "DC240C", "DC240D", "DC240E",
    "DC248", "DC249", "DC787",
]


def load_population(procedures: DataFrame, prefix: str = POPULATION_PREFIX) -> DataFrame:
    """K1: procedure rows whose code starts with the seed prefix; dates parsed."""
    p = prefix_filter(procedures, "ProcedureCode", prefix)
    return p.withColumn("ServiceDate", ts_column(p, "ServiceDate")) \
            .withColumn("ServiceDatetime", ts_column(p, "ServiceDatetime"))


def load_adt(adt: DataFrame) -> DataFrame:
    """K2: parse move times (bad -> null), move-in events +1 s."""
    d = adt.withColumn("Flyt_ind", ts_column(adt, "Flyt_ind")).withColumn("Flyt_ud", ts_column(adt, "Flyt_ud"))
    return d.withColumn("Flyt_ind", shift_where(F.col("Flyt_ind"), F.col("ADT_haendelse") == "Flyt Ind"))


def match_population_to_trajectories(of: DataFrame, population: DataFrame,
                                     proc_cols: Sequence[str] | None = None,
                                     tie_cols: Sequence[str] = ("ServiceDatetime", "ProcedureCode")) -> DataFrame:
    """K5: procedures within ``[start-1d, end+1d]`` of a trajectory (J3);
    several procedures of a trajectory become its ordered array
    ``procedures`` (R1, nested: the schema does not grow with the data; the
    first one's columns stand beside it as ``{col}_1``); the other columns
    from its earliest procedure (W7); trajectory start/end attached;
    population rows left unmatched are appended with null trajectory and one
    procedure (J7)."""
    if proc_cols is None:
        proc_cols = [c for c in population.columns if c.startswith("Procedure")] + ["ServiceDatetime"]
    fdf = match_trajectories(of, population, "ServiceDate")
    keys = ["CPR_hash", "trajectory"]
    order = ["ServiceDate", *tie_cols]
    rest = [c for c in fdf.columns if c not in proc_cols and c not in keys]
    # the earliest row as a whole and all procedures in order: one aggregate
    item = F.struct(F.struct(*order).alias("__o"), F.struct(*proc_cols).alias("__v"))
    grouped = fdf.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"),
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__v"]).alias("procedures"))
    first = [F.get("procedures", F.lit(0))[c].alias(f"{c}_1") for c in proc_cols]
    df = grouped.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest], "procedures", *first) \
                .join(of.select(*keys, "start", "end", "duration"), keys, "left")
    renames = {c: f"{c}_1" for c in proc_cols}
    single = population.withColumn("procedures", F.array(F.struct(*proc_cols)))
    # read twice by the append (as rows and as keys): stored once
    return anti_reappend(single, cut_lineage(df), ["CPR_hash", "ServiceDate"], renames)


def add_first_contacts(df: DataFrame, adt: DataFrame, site_pattern: str = codes.SITE_PATTERN) -> DataFrame:
    """K6 (A8, A9): first department inside [start, end] and first move-in
    at the site; ``time_to_RH`` = first site time - start."""
    keys = df.select("CPR_hash", "ServiceDate", "start", "end").distinct()
    inside = window_join(adt, keys, "CPR_hash", "Flyt_ind", F.col("start"), F.col("end"),
                         carry=["ServiceDate", "start"], distinct=False)
    import re
    site = F.col("Afsnit").rlike("(?iU)" + re.escape(site_pattern))
    order = F.struct(F.col("Flyt_ind"), F.col("Afsnit"))
    firsts = inside.groupBy("CPR_hash", "ServiceDate", "start").agg(
        F.min_by(F.col("Afsnit"), F.when(F.col("Afsnit").isNotNull(), order)).alias("first_afsnit"),
        F.min(F.when(site, F.col("Flyt_ind"))).alias("first_RH"))
    firsts = firsts.withColumn("time_to_RH", F.col("first_RH") - F.col("start"))
    return df.join(firsts, ["CPR_hash", "ServiceDate", "start"], "left")


def add_first_hospital(df: DataFrame) -> DataFrame:
    """K7: FIRST_HOSPITAL from the first department (frame form: empty
    name -> MISC)."""
    d = df.withColumn("first_afsnit", F.regexp_replace("first_afsnit", ",", ""))
    return d.withColumn("FIRST_HOSPITAL", codes.derive_first_hospital(F.col("first_afsnit"), empty_is_null=False))


def add_case_knife_time(df: DataFrame, cases: DataFrame) -> DataFrame:
    """K8: start/end pairing per case (J12) then the knife time nearest to
    ServiceDate within 24 h per (CPR_hash, ServiceDate) (J5)."""
    c = cases.withColumn("Operationshændelses_Tidspunkt", ts_column(cases, "Operationshændelses_Tidspunkt"))
    # only the earliest end of a case can be picked (ties go to it), so a case's ends are reduced before the pairing
    knife = pair_start_end(c, first_end=True)
    return nearest_in_time(df, knife, "CPR_hash", "ServiceDate", "knife_time",
                           ["CPR_hash", "ServiceDate"], tie_cols=["Case_ID", "knife_time_end"],
                           right_cols=["Case_ID", "knife_time", "knife_time_end", "elapsed_knife_time_minutes"])


def add_diagnoses(df: DataFrame, diagnoses: DataFrame,
                  inclusion: Sequence[str] = DIAGNOSIS_INCLUSION) -> DataFrame:
    """K9: included diagnoses noted in ``[start - 6 months, end]`` (J4),
    in order of note time per (CPR_hash, ServiceDate) as the array
    ``diagnoses`` (R2, nested)."""
    d = diagnoses.where(F.col("Diagnosekode").isin(list(inclusion))) \
                 .withColumn("Noteret_dato", ts_column(diagnoses, "Noteret_dato"))
    keys = df.select("CPR_hash", "ServiceDate", "start", "end").distinct()
    m = lookback_join(keys, d, "Noteret_dato", months=6, carry=["ServiceDate"])
    found = numbered_collection(m, ["CPR_hash", "ServiceDate"], ["Noteret_dato", "Diagnosekode"], ["Diagnosekode"], "diagnoses")
    return df.join(found, ["CPR_hash", "ServiceDate"], "left")


def add_patient_info(df: DataFrame, info: DataFrame) -> DataFrame:
    """DOB/DOD/SEX (sex normalised, X8) and the overlap-with-next flag
    per patient in (start, ServiceDate) order (W5)."""
    pi = info.select("CPR_hash", ts_column(info, "Fødselsdato").alias("DOB"),
                     ts_column(info, "Dødsdato").alias("DOD"),
                     codes.recode(F.col("Køn"), {"Mand": "Male", "Kvinde": "Female"}).alias("SEX"))
    d = df.join(pi, "CPR_hash", "left")
    # rows without a start cannot be ordered: flag False, same as a last row
    return overlap_with_next(d.withColumn("__s", F.coalesce("start", F.lit("9999-12-31").cast("timestamp_ntz"))),
                             "CPR_hash", start="__s").drop("__s") \
        .withColumn("overlap", F.col("start").isNotNull() & F.col("overlap"))


def add_patient_id(df: DataFrame, string_col: str = "CPR_hash", date_col: str = "ServiceDate") -> DataFrame:
    """Dense PID per distinct (id, date), numbered in key order."""
    return dense_rank_global(df, [string_col, date_col])


def final_cleanup(df: DataFrame) -> DataFrame:
    """Drop ADT helper columns; keep one row per PID, then one per
    (CPR_hash, start, end) -- the row with the smallest PID (total order)."""
    d = df.drop("Flyt_ind", "Flyt_ud", "ADT_haendelse")
    cols = d.columns
    one = d.groupBy("PID").agg(F.min_by(F.struct(*cols), F.struct(*[c for c in cols if c != "PID"])).alias("r")) \
           .select("r.*")
    key = ["CPR_hash", "start", "end"]
    return one.groupBy(*key).agg(F.min_by(F.struct(*cols), F.col("PID")).alias("r")).select("r.*")


def height_weight(base: DataFrame, vitals: DataFrame) -> DataFrame:
    """K13 height/weight: numeric vitals 'Højde'/'Vægt' converted (in->cm,
    oz->kg), the latest value at or before ``end`` per PID, as HEIGHT /
    WEIGHT (R3, W6).

    One ordered scan per patient over measurements and stay ends carries
    the last values along, instead of joining every measurement with every
    stay of a patient; of several values at one instant the largest counts."""
    v = vitals.withColumn("FEATURE", codes.recode(F.col("Vital_parametre"), codes.HEIGHT_WEIGHT_MAP)) \
              .withColumn("t", ts_column(vitals, "Registreringstidspunkt")) \
              .where(F.col("t").isNotNull() & F.col("FEATURE").isin("HEIGHT", "WEIGHT")) \
              .withColumn("VALUE", numeric_or_null(F.col("Værdi")))
    v = worked_out_once(v, "VALUE").where(F.col("VALUE").isNotNull())
    measured = v.select(
        "CPR_hash", "t", F.lit(0).alias("kind"), F.col("VALUE").alias("tie"), F.lit(None).cast("bigint").alias("PID"),
        F.when(F.col("FEATURE") == "HEIGHT", F.col("VALUE") * 2.54).alias("h"),
        F.when(F.col("FEATURE") == "WEIGHT", F.col("VALUE") * 0.0283495231).alias("w"))
    none = F.lit(None).cast("double")
    ends = base.where(F.col("end").isNotNull()).select(
        "CPR_hash", F.col("end").alias("t"), F.lit(1).alias("kind"), F.col("PID").cast("double").alias("tie"),
        F.col("PID").cast("bigint").alias("PID"), none.alias("h"), none.alias("w"))
    order = ["t", "kind", "tie"]
    ranged = range_buckets(measured.unionByName(ends).where(F.col("CPR_hash").isNotNull()), ["CPR_hash", *order])
    seen = ordered_scan(ranged, ["CPR_hash"], order, "__rb", last={"HEIGHT": "h", "WEIGHT": "w"})
    return seen.where((F.col("kind") == 1) & (F.col("HEIGHT").isNotNull() | F.col("WEIGHT").isNotNull())) \
               .select("PID", "HEIGHT", "WEIGHT")


def add_to_base(base: DataFrame, vitals: DataFrame | None = None) -> DataFrame:
    """DURATION (days), AGE, HEIGHT/WEIGHT, DECEASED_30d / _90d."""
    d = base.withColumn("DURATION", days_between(F.col("start"), F.col("end"))) \
            .withColumn("AGE", age_years(F.col("DOB"), F.col("start")))
    if vitals is not None:
        d = left_join_unique(d, height_weight(base, vitals), "PID")
    return d.withColumn("DECEASED_30d", event_within_days(F.col("DOD"), F.col("start"), 30)) \
            .withColumn("DECEASED_90d", event_within_days(F.col("DOD"), F.col("start"), 90))


def create_base(procedures: DataFrame, adt: DataFrame, cases: DataFrame, diagnoses: DataFrame,
                patient_info: DataFrame, vitals: DataFrame | None = None, comorbidity: bool = True,
                gap_hours: float = 1.0) -> DataFrame:
    """The cohort job end to end."""
    from .comorbidity import add_comorbidity
    # Stage boundaries (reliable checkpoints): trajectories, the matched
    # cohort and the enriched cohort are each used by several later joins;
    # materialising them keeps every plan short and lets a lost executor
    # recompute from the last stored stage only.
    population = load_population(procedures)
    moves = load_adt(adt)
    of = cut_lineage(build_trajectories(moves, gap_hours=gap_hours, tie_cols=["Flyt_ud", "ADT_haendelse", "Afsnit"]))
    matched = cut_lineage(fill_window_from_date(match_population_to_trajectories(of, population)))
    d = add_first_contacts(matched, moves)
    d = add_first_hospital(d)
    d = add_case_knife_time(d, cases)
    d = add_diagnoses(d, diagnoses)
    d = cut_lineage(add_patient_info(d, patient_info))
    d = add_patient_id(d)
    d = cut_lineage(final_cleanup(d))
    d = add_to_base(d, vitals)
    if comorbidity:
        d = add_comorbidity(d, diagnoses)
    return d
