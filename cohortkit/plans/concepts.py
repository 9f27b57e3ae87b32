"""Per-table normalisers into the long model (C1-C7) and their registry
(F1).  Every normaliser is ``DataFrame -> DataFrame`` for ``df.transform``
(F2) and uses only built-in expressions (no UDF)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.numeric import HAS_DIGIT_RE, lab_clean, numeric_or_null
from ..operators.reshape import split_blood_pressure
from ..operators.trajectories import fill_missing_end
from ..session import worked_out_once


def filter_vitals(vit: DataFrame, with_height_weight: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """C1 (+C2): Temp. takes the converted value; BP ``sys/dia`` -> SBP/DBP;
    names mapped; height (in) / weight (oz) converted; only mapped vitals
    with a non-null, number-looking VALUE stay.  ``with_height_weight``
    also returns the height/weight side output (C2)."""
    v = vit.withColumn("Værdi", F.when(F.col("Vital_parametre") == "Temp.", F.col("Værdi_Omregnet"))
                                 .otherwise(F.col("Værdi")))
    v = v.select(F.col("Registreringstidspunkt").alias("TIMESTAMP"), "PID",
                 F.col("Vital_parametre").alias("FEATURE"), F.col("Værdi").cast("string").alias("VALUE"))
    v = split_blood_pressure(v, codes.BP_TYPES)
    v = v.withColumn("FEATURE", codes.recode(codes.recode(F.col("FEATURE"), codes.VITALS_MAP),
                                             codes.HEIGHT_WEIGHT_MAP))
    num = numeric_or_null(F.col("VALUE"))
    v = v.withColumn("VALUE", F.when(F.col("FEATURE") == "HEIGHT", (num * 2.54).cast("string"))
                                .when(F.col("FEATURE") == "WEIGHT", (num * 0.0283495231).cast("string"))
                                .otherwise(F.col("VALUE")))
    main = v.where(F.col("FEATURE").isin(sorted(set(codes.VITALS_MAP.values())))
                   & F.col("VALUE").isNotNull() & F.col("VALUE").rlike(HAS_DIGIT_RE))
    if with_height_weight:
        hw = v.where(F.col("FEATURE").isin(sorted(set(codes.HEIGHT_WEIGHT_MAP.values()))))
        return main, hw
    return main


def filter_procedures(proc: DataFrame, procedure_map: Mapping[str, Sequence[str]]) -> DataFrame:
    """Procedures in the caller's catalogue (category -> codes), VALUE =
    category, FEATURE = 'procedures'.  The catalogue is a parameter (a
    site-specific table of a few hundred codes), looked up by broadcast."""
    rev = codes.invert(procedure_map)
    spark = proc.sparkSession
    cat = spark.createDataFrame(sorted(rev.items()), "ProcedureCode string, __cat string")
    p = proc.join(F.broadcast(cat), "ProcedureCode", "inner")
    return p.withColumnRenamed("ServiceDatetime", "TIMESTAMP").withColumn("VALUE", F.col("__cat")) \
            .withColumn("FEATURE", F.lit("procedures")).drop("__cat", "ProcedureCode")


def filter_labs(lab: DataFrame) -> DataFrame:
    """C4: clean the result text (``,``->``.``, no ``*``), keep
    number-looking rows of the listed tests, strip ``<``/``>``, parse
    (invalid dropped), rename tests to features."""
    include = sorted(codes.LABS_REVERSE_MAP)
    # the cleaning takes no digit away: rows are kept by the text as it is
    d = lab.where(F.col("Resultatværdi").isNotNull() & F.col("Resultatværdi").rlike(HAS_DIGIT_RE)) \
           .where(F.col("BestOrd").isin(include))
    d = d.withColumnRenamed("BestOrd", "FEATURE").withColumnRenamed("Resultatværdi", "VALUE") \
         .withColumnRenamed("Prøvetagningstidspunkt", "TIMESTAMP")
    d = worked_out_once(d.withColumn("VALUE", lab_clean(F.col("VALUE"))), "VALUE")
    d = worked_out_once(d.withColumn("VALUE", numeric_or_null(F.col("VALUE"))), "VALUE").where(F.col("VALUE").isNotNull())
    return d.withColumn("FEATURE", codes.recode(F.col("FEATURE"), codes.LABS_REVERSE_MAP))


def filter_ita(ita: DataFrame) -> DataFrame:
    """ICU score rows renamed; names mapped, others kept."""
    d = ita.withColumnRenamed("ITAOversigt_Måling", "FEATURE").withColumnRenamed("Værdi", "VALUE") \
           .withColumnRenamed("Målingstidspunkt", "TIMESTAMP")
    return d.withColumn("FEATURE", codes.recode(F.col("FEATURE"), codes.ICU_MAP))


def filter_medicin(med: DataFrame) -> DataFrame:
    """Administered rows; one row per ATC level (3 and 4) that maps to a
    category (X6), distinct; VALUE = category, FEATURE = 'medication';
    start/end renamed, TIMESTAMP = start."""
    d = med.where(F.col("Handling").isin(codes.MEDICATION_ACTION_LIST)) \
           .withColumn("ATC3", F.substring("ATC", 1, 3)).withColumn("ATC4", F.substring("ATC", 1, 4))
    found = F.array(codes.lookup(F.col("ATC3"), codes.ATC_LVL3_REVERSE), codes.lookup(F.col("ATC4"), codes.ATC_LVL4_REVERSE))
    m = d.withColumn("FEATURE", F.explode(F.array_compact(found))).distinct()
    m = m.withColumn("VALUE", F.col("FEATURE")).withColumn("FEATURE", F.lit("medication"))
    m = m.withColumnRenamed("Administrationstidspunkt", "start").withColumnRenamed("Seponeringstidspunkt", "end")
    return m.withColumn("TIMESTAMP", F.col("start"))


def filter_adt(adt: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Classify departments (X1), drop unknown, fill a missing move-out
    from the next move-in of the same PID, else the base end (W4); interval
    concept ``TIMESTAMP``..``END_TIMESTAMP``."""
    d = adt.withColumn("VALUE", codes.classify(F.col("Afsnit"))).withColumn("FEATURE", F.lit("ADT")) \
           .where(F.col("VALUE").isNotNull())
    fallback = None
    if base is not None:
        d = d.join(base.select("PID", F.col("end").alias("__base_end")), "PID", "left")
        fallback = "__base_end"
    ties = [c for c in ("Flyt_ud", "ADT_haendelse", "Afsnit") if c in d.columns]  # moves at one instant keep one order
    d = fill_missing_end(d, "PID", "Flyt_ind", "Flyt_ud", fallback, tie_cols=ties)
    d = d.withColumn("TIMESTAMP", F.col("Flyt_ind")).withColumn("END_TIMESTAMP", F.col("Flyt_ud"))
    return d.drop("__base_end") if fallback else d


NORMALISERS: dict[str, Callable[..., DataFrame]] = {
    "VitaleVaerdier": filter_vitals,
    "ITAOversigtsrapport": filter_ita,
    "Labsvar": filter_labs,
    "Medicin": filter_medicin,
    "Procedurer": filter_procedures,
    "ADTHaendelser": filter_adt,
}


def collect_filter(concept: str, **settings) -> Callable[[DataFrame], DataFrame]:
    """normaliser of a concept as ``DataFrame -> DataFrame``; unknown
    names raise KeyError.  ``settings`` go to the normaliser: ``Procedurer``
    needs ``procedure_map`` (category -> codes)."""
    if concept not in NORMALISERS:
        raise KeyError(f"{concept!r} has no normaliser; known: {', '.join(sorted(NORMALISERS))}")
    f = NORMALISERS[concept]
    if f is filter_procedures and "procedure_map" not in settings:
        raise ValueError("the normaliser of 'Procedurer' needs procedure_map=...")
    return partial(f, **settings) if settings else f
