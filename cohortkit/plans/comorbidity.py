"""Comorbidity flags and scores.

Published ICD-10 definitions (Quan et al. 2005 coding algorithms; Charlson
weights of Quan et al. 2011, Elixhauser weights of van Walraven et al.
2009).  A condition is present when a diagnosis code *starts with* one of
its prefixes.  Codes are matched by exploding each code into its prefixes
and joining with the (fixed, small, broadcast) prefix table -- an equi join,
no pattern scan per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import strip_code_ends
from ..operators.joins import left_join_unique
from ..operators.ordered import ordered_scan, range_buckets
from ..session import cut_lineage
from ..functions.timefns import ts_column


def expand(spec: str) -> list[str]:
    """'I425-I429 I43 E10x[016]' -> prefixes.  ``A-B`` ranges step the
    numeric tail; ``STEMx[digits]`` appends each digit to each stem."""
    out: list[str] = []
    for tok in spec.split():
        if "x[" in tok:
            stem, digits = tok.split("x[")
            stems = expand(stem.replace("/", " "))
            out += [s + d for s in stems for d in digits.rstrip("]")]
        elif "-" in tok:
            a, b = tok.split("-")
            letter, lo, hi = a[0], int(a[1:]), int(b[1:])
            width = len(a) - 1
            out += [f"{letter}{n:0{width}d}" for n in range(lo, hi + 1)]
        else:
            out.append(tok)
    return out


# Fixed values (published definitions): condition -> (weight, prefixes).
DIAB_STEMS = "E10/E11/E12/E13/E14"
CHARLSON = {
    "mi": (0, "I21 I22 I252"),
    "chf": (2, "I099 I110 I130 I132 I255 I420 I425-I429 I43 I50 P290"),
    "pvd": (0, "I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959"),
    "cevd": (0, "G45 G46 H340 I60-I69"),
    "dementia": (2, "F00-F03 F051 G30 G311"),
    "cpd": (1, "I278 I279 J40-J47 J60-J67 J684 J701 J703"),
    "rheumd": (1, "M05 M06 M315 M32-M34 M351 M353 M360"),
    "pud": (0, "K25-K28"),
    "mld": (2, "B18 K700-K703 K709 K713-K715 K717 K73 K74 K760 K762-K764 K768 K769 Z944"),
    "diab": (0, f"{DIAB_STEMS}x[01689]"),
    "diabwc": (1, f"{DIAB_STEMS}x[23457]"),
    "hp": (2, "G041 G114 G801 G802 G81 G82 G830-G834 G839"),
    "rend": (1, "I120 I131 N032-N037 N052-N057 N18 N19 N250 Z490-Z492 Z940 Z992"),
    "canc": (2, "C00-C26 C30-C34 C37-C41 C43 C45-C58 C60-C76 C81-C85 C88 C90-C97"),
    "msld": (4, "I850 I859 I864 I982 K704 K711 K721 K729 K765-K767"),
    "metacanc": (6, "C77-C80"),
    "aids": (4, "B20-B22 B24"),
}
CHARLSON_ZERO = {"diab": "diabwc", "mld": "msld", "canc": "metacanc"}

ELIXHAUSER = {
    "chf": (7, CHARLSON["chf"][1]),
    "carit": (5, "I441-I443 I456 I459 I47-I49 R000 R001 R008 T821 Z450 Z950"),
    "valv": (-1, "A520 I05-I08 I091 I098 I34-I39 Q230-Q233 Z952-Z954"),
    "pcd": (4, "I26 I27 I280 I288 I289"),
    "pvd": (2, CHARLSON["pvd"][1]),
    "hypunc": (0, "I10"),
    "hypc": (0, "I11-I13 I15"),
    "para": (7, CHARLSON["hp"][1]),
    "ond": (6, "G10-G13 G20-G22 G254 G255 G312 G318 G319 G32 G35-G37 G40 G41 G931 G934 R470 R56"),
    "cpd": (3, CHARLSON["cpd"][1]),
    "diabunc": (0, f"{DIAB_STEMS}x[019]"),
    "diabc": (0, f"{DIAB_STEMS}x[2345678]"),
    "hypothy": (0, "E00-E03 E890"),
    "rf": (5, "I120 I131 N18 N19 N250 Z490-Z492 Z940 Z992"),
    "ld": (11, "B18 I85 I864 I982 K70 K711 K713-K715 K717 K72-K74 K760 K762-K769 Z944"),
    "pud": (0, "K257 K259 K267 K269 K277 K279 K287 K289"),
    "aids": (0, "B20-B22 B24"),
    "lymph": (9, "C81-C85 C88 C96 C900 C902"),
    "metacanc": (12, "C77-C80"),
    "solidtum": (4, "C00-C26 C30-C34 C37-C41 C43 C45-C58 C60-C76 C97"),
    "rheumd": (0, "L940 L941 L943 M05 M06 M08 M120 M123 M30 M310-M313 M32-M35 M45 M461 M468 M469"),
    "coag": (3, "D65-D68 D691 D693-D696"),
    "obes": (-4, "E66"),
    "wloss": (6, "E40-E46 R634 R64"),
    "fed": (5, "E222 E86 E87"),
    "blane": (-2, "D500"),
    "dane": (-2, "D508 D509 D51-D53"),
    "alcohol": (0, "F10 E52 G621 I426 K292 K700 K703 K709 T51 Z502 Z714 Z721"),
    "drug": (-7, "F11-F16 F18 F19 Z715 Z722"),
    "psycho": (0, "F20 F22-F25 F28 F29 F302 F312 F315"),
    "depre": (-3, "F204 F313-F315 F32 F33 F341 F412 F432"),
}
ELIX_ZERO = {"hypunc": "hypc", "diabunc": "diabc", "solidtum": "metacanc"}


def prefix_table(spark: SparkSession) -> DataFrame:
    """(scheme, cond, prefix) rows of both maps (a few hundred rows)."""
    rows = [("CHAR", c, p) for c, (_, s) in CHARLSON.items() for p in expand(s)]
    rows += [("ELIX", c, p) for c, (_, s) in ELIXHAUSER.items() for p in expand(s)]
    return spark.createDataFrame(rows, "scheme string, cond string, prefix string")


def condition_flags(diagnoses: DataFrame) -> DataFrame:
    """X11 + prefix lookup: (CPR_hash, noted, resolved, flag) per diagnosis
    and condition of its code; every diagnosis also has the flag ``ANY``."""
    spark = diagnoses.sparkSession
    longest = max(len(p) for m in (CHARLSON, ELIXHAUSER) for _, s in m.values() for p in expand(s))
    d = diagnoses.select("CPR_hash", ts_column(diagnoses, "Noteret_dato").alias("noted"),
                         ts_column(diagnoses, "Løst_dato").alias("resolved"),
                         strip_code_ends(F.col("Diagnosekode")).alias("code")).where(F.col("noted").isNotNull())
    pref = d.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.greatest(F.length("code"), F.lit(1)), F.lit(longest))))) \
            .withColumn("prefix", F.substring("code", F.lit(1), F.col("n")))
    hits = pref.join(F.broadcast(prefix_table(spark)), "prefix", "inner") \
               .select("CPR_hash", "noted", "resolved", F.concat_ws("_", "scheme", "cond").alias("flag"))
    return hits.unionByName(d.select("CPR_hash", "noted", "resolved", F.lit("ANY").alias("flag")))


def active_flags(base: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Distinct (PID, flag) of the conditions active at the index start.

    A diagnosis is active for starts from a day after it is noted to a day
    before it is resolved.  Per (patient, condition) one ordered scan over
    these bounds and the patient's starts counts what is open, so a
    patient's diagnoses are never joined with each of its stays; a stay is
    repeated once per condition of its patient (at most the length of the
    condition list)."""
    day = F.make_interval(days=F.lit(1))
    f = condition_flags(diagnoses).withColumn("first", F.col("noted") + day).withColumn("last", F.col("resolved") - day)
    f = cut_lineage(f.where(F.col("last").isNull() | (F.col("last") >= F.col("first"))))  # read four times below
    no_pid = F.lit(None).cast("bigint").alias("PID")
    opens = f.select("CPR_hash", "flag", F.col("first").alias("t"), F.lit(0).alias("kind"), no_pid, F.lit(1).alias("step"))
    closes = f.where(F.col("last").isNotNull()).select(
        "CPR_hash", "flag", F.col("last").alias("t"), F.lit(2).alias("kind"), no_pid, F.lit(-1).alias("step"))
    known = f.groupBy("CPR_hash").agg(F.collect_set("flag").alias("flags"))
    starts = base.where(F.col("start").isNotNull()).select("CPR_hash", "PID", "start").join(known, "CPR_hash").select(
        "CPR_hash", F.explode("flags").alias("flag"), F.col("start").alias("t"), F.lit(1).alias("kind"),
        F.col("PID").cast("bigint").alias("PID"), F.lit(0).alias("step"))
    # events at one instant are added up first, so that the order is total
    moves = opens.unionByName(closes).groupBy("CPR_hash", "flag", "t", "kind", "PID").agg(F.sum("step").alias("step"))
    rows = moves.unionByName(starts.withColumn("step", F.col("step").cast("bigint"))) \
                .withColumn("tie", F.coalesce("PID", F.lit(0)))
    keys, order = ["CPR_hash", "flag"], ["t", "kind", "tie"]
    seen = ordered_scan(range_buckets(rows, [*keys, *order]), keys, order, "__rb", cumsum={"open": "step"})
    return seen.where((F.col("kind") == 1) & (F.col("open") > 0)).select("PID", "flag").distinct()


def comorbidity_scores(flags: DataFrame) -> DataFrame:
    """Per PID the 0/1 flags ``ELIX_*`` / ``CHAR_*`` (milder flag
    zeroed when the severe one is set) and ``ASMT_ELIX`` /
    ``ASMT_CHARLSON`` weighted sums, from (PID, flag).  Only PIDs with the
    flag ``ANY``, i.e. any active diagnosis, appear."""
    names = [f"ELIX_{c}" for c in ELIXHAUSER] + [f"CHAR_{c}" for c in CHARLSON]
    # a bit per flag (49 of 63), set in one aggregate: no pivot, and no join of those with any diagnosis to it
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("flag"))
    bit = F.when((place > 0) & F.col("PID").isNotNull(), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place - 1).cast("int")))
    wide = flags.groupBy("PID").agg(F.bit_or(bit).alias("__bits"), F.bool_or(F.col("flag") == "ANY").alias("__any"))
    bits = F.coalesce("__bits", F.lit(0).cast("bigint"))
    wide = wide.where("__any").select("PID", *[F.getbit(bits, F.lit(i)).cast("int").alias(n) for i, n in enumerate(names)])
    for scheme, zero in (("ELIX", ELIX_ZERO), ("CHAR", CHARLSON_ZERO)):
        for mild, severe in zero.items():
            m, s = f"{scheme}_{mild}", f"{scheme}_{severe}"
            wide = wide.withColumn(m, F.when(F.col(s) == 1, F.lit(0)).otherwise(F.col(m)))
    elix = sum(F.col(f"ELIX_{c}") * w for c, (w, _) in ELIXHAUSER.items())
    char = sum(F.col(f"CHAR_{c}") * w for c, (w, _) in CHARLSON.items())
    return wide.withColumn("ASMT_ELIX", elix.cast("double")).withColumn("ASMT_CHARLSON", char.cast("double"))


def add_comorbidity(base: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Scores joined onto the base by PID; PIDs without pre-index
    diagnoses keep nulls.  The join must keep the row count (J11)."""
    return left_join_unique(base, comorbidity_scores(active_flags(base, diagnoses)), "PID")
