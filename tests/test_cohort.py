"""End-to-end cohort job (K22) and concept jobs on a small clinical fixture."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortkit.config import default_config
from cohortkit.plans.binning import map_concept
from cohortkit.plans.cohort import create_base
from cohortkit.plans.concepts import collect_filter, filter_adt, filter_labs, filter_medicin, filter_vitals
from cohortkit.plans.features import AggregatedDataset
from cohortkit.sources import schemas


@pytest.fixture(scope="module")
def clinical(spark):
    mk = spark.createDataFrame
    adt = mk([("p1", "Indlæggelse", "2024-01-01 08:00:00", "2024-01-01 12:00:00", "RH TRAUMECENTER"),
              ("p1", "Flyt Ind", "2024-01-01 12:00:00", "2024-01-03 10:00:00", "RH INTENSIV"),
              ("p1", "Indlæggelse", "2024-03-01 08:00:00", "2024-03-02 08:00:00", "HGH SENGEAFSNIT"),
              ("p2", "Indlæggelse", "2024-02-01 00:00:00", None, "SJ HOLBÆK OPERATIONSGANG"),
              ("p2", "Flyt Ind", "2024-02-01 05:00:00", "2024-02-02 00:00:00", "SJ HOLBÆK SENGEAFSNIT")], schemas.ADT)
    proc = mk([("p1", "KJJA96", "2024-01-01", "2024-01-01 10:00:00"), ("p1", "KJJB00", "2024-01-02", "2024-01-02 09:00:00"),
               ("p2", "KJJW96", "2024-02-01", "2024-02-01 06:00:00"), ("p3", "KJJA50", "2024-05-05", "2024-05-05 07:00:00"),
               ("p1", "KNHJ63", "2024-01-01", "2024-01-01 11:00:00")], schemas.PROCEDURES)
    cases = mk([("p1", "c1", "KJJA96", "Knivtid/procedure start", "2024-01-01 10:05:00", "Fuldført"),
                ("p1", "c1", "KJJA96", "Sidste sutur/procedure slut", "2024-01-01 11:35:00", None)], schemas.CASES)
    diag = mk([("p1", "DC221A", "2023-12-01 00:00:00", None), ("p1", "DI219", "2023-11-01 00:00:00", None),
               ("p2", "DE1190", "2023-01-01 00:00:00", "2023-06-01 00:00:00")], schemas.DIAGNOSES)
    info = mk([("p1", "1950-06-01", None, "Mand"), ("p2", "1980-01-01", "2024-02-20 00:00:00", "Kvinde"),
               ("p3", "1990-01-01", None, "Kvinde")], schemas.PATIENT_INFO)
    vit = mk([("p1", "Højde", "70", None, "2024-01-01 09:00:00"), ("p1", "Vægt", "2800", None, "2024-01-01 09:00:00"),
              ("p1", "BT", "120/80", None, "2024-01-01 09:30:00"), ("p1", "Temp.", "99", "37.2", "2024-01-01 09:30:00")],
             schemas.VITALS)
    return dict(adt=adt, proc=proc, cases=cases, diag=diag, info=info, vit=vit)


def test_create_base(spark, clinical):
    c = clinical
    b = create_base(c["proc"], c["adt"], c["cases"], c["diag"], c["info"], c["vit"]).cache()
    rows = {(r.CPR_hash, r.ServiceDate.date().isoformat()): r for r in b.collect()}
    p1 = rows[("p1", "2024-01-01")]
    assert p1.trajectory == "1" and p1.start == dt.datetime(2024, 1, 1, 8) and p1.end == dt.datetime(2024, 1, 3, 10)
    assert p1.FIRST_HOSPITAL == "RH" and p1.first_afsnit == "RH TRAUMECENTER"
    assert p1.knife_time == dt.datetime(2024, 1, 1, 10, 5) and p1.elapsed_knife_time_minutes == 90.0
    assert p1.SEX == "Male" and p1.AGE == 73 and p1.DECEASED_90d == 0.0
    assert abs(p1.HEIGHT - 177.8) < 1e-9 and abs(p1.WEIGHT - 79.378665) < 1e-6
    assert p1.CHAR_mi == 1 and p1.diagnoses[0].Diagnosekode == "DC221A"
    assert ("p1", "2024-01-02") in rows and rows[("p1", "2024-01-02")].trajectory is None  # later procedure re-appended
    p3 = rows[("p3", "2024-05-05")]
    assert p3.start == p3.end == dt.datetime(2024, 5, 5)  # unmatched: window from the service date
    p2 = rows[("p2", "2024-02-01")]
    assert p2.DECEASED_30d == 1.0
    assert sorted(r.PID for r in b.collect()) == list(range(1, b.count() + 1))


def test_normalisers_and_mapping(spark, clinical):
    vit = clinical["vit"].withColumn("PID", F.lit(1).cast("long")) \
        .withColumn("Registreringstidspunkt", F.col("Registreringstidspunkt").cast("timestamp_ntz"))
    main, hw = filter_vitals(vit, with_height_weight=True)
    assert {(r.FEATURE, r.VALUE) for r in main.collect()} == {("SBP", "120.0"), ("DBP", "80.0"), ("TEMP", "37.2")}
    assert {r.FEATURE for r in hw.collect()} == {"HEIGHT", "WEIGHT"}
    with pytest.raises(KeyError):
        collect_filter("Unknown")
    base = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 12))],
                                 "PID long, start timestamp_ntz, end timestamp_ntz")
    adt = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 8), None, "RH ITA 1"), (1, dt.datetime(2024, 1, 1, 9), None, "KØKKEN"),
                                 (1, dt.datetime(2024, 1, 1, 10), None, "HGH SENGEAFSNIT")],
                                "PID long, Flyt_ind timestamp_ntz, Flyt_ud timestamp_ntz, Afsnit string")
    iv = filter_adt(adt, base).orderBy("TIMESTAMP").collect()
    assert [(r.VALUE, r.END_TIMESTAMP.hour) for r in iv] == [("ICU", 10), ("BED", 12)]
    binned = map_concept(filter_adt(adt, base).select("PID", "TIMESTAMP", "END_TIMESTAMP", "FEATURE", "VALUE"),
                         base, default_config(), "last", is_categorical=True)
    vals = [r.VALUE for r in binned.orderBy("bin_counter").collect()]
    assert vals[0] == "ICU" and vals[-1] == "BED"


def test_aggregated_dataset(spark):
    base = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 70, 1.0), (2, dt.datetime(2024, 1, 1), 50, 0.0)],
                                 "PID long, start timestamp_ntz, AGE long, DECEASED_90d double")
    labs = spark.createDataFrame([(1, "LAKTAT;P(AB)", "<2,5", dt.datetime(2024, 1, 1, 1)),
                                  (1, "LAKTAT;P(AB)", "4.0", dt.datetime(2024, 1, 3)),
                                  (9, "LAKTAT;P(AB)", "1.0", dt.datetime(2024, 1, 1, 1))],
                                 "PID long, BestOrd string, `Resultatværdi` string, `Prøvetagningstidspunkt` timestamp_ntz")
    med = spark.createDataFrame([(2, "J01CA04", "Administreret", dt.datetime(2024, 1, 1, 2), None)],
                                "PID long, ATC string, Handling string, Administrationstidspunkt timestamp_ntz, "
                                "Seponeringstidspunkt timestamp_ntz")
    cfg = default_config(target="DECEASED_90d")
    cfg["dataset"].update({"num_cols": ["AGE"], "cat_cols": [], "ts_cat_names": ["Medicin"]})
    ds = AggregatedDataset(cfg, base, {"Labsvar": labs, "Medicin": med}, masking_point="24h",
                           normalisers={"Labsvar": filter_labs, "Medicin": filter_medicin})
    out = {r.PID: r for r in ds.build().collect()}
    assert out[1].LACTATE_Labsvar_mean == 2.5 and out[2].LACTATE_Labsvar_mean == 0.0
    assert out[2].antibiotics_Medicin_given == 1 and out[1].antibiotics_Medicin_count == 0
    cont, cat = ds.features_by_type()
    assert "antibiotics_Medicin_given" in cat and "LACTATE_Labsvar_std" in cont
