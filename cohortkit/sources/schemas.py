"""Declared schemas of the clinical inputs and the intermediate frames.

Raw clinical times arrive as text and are parsed by the operators (D1)."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampNTZType)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, TS, L, D, I, B = StringType(), TimestampNTZType(), LongType(), DoubleType(), IntegerType(), BooleanType()

PROCEDURES = _s(("CPR_hash", S), ("ProcedureCode", S), ("ServiceDate", S), ("ServiceDatetime", S))
ADT = _s(("CPR_hash", S), ("ADT_haendelse", S), ("Flyt_ind", S), ("Flyt_ud", S), ("Afsnit", S))
CASES = _s(("CPR_hash", S), ("Case_ID", S), ("SKS_Kode", S), ("Operationshændelse", S),
           ("Operationshændelses_Tidspunkt", S), ("Status", S))
DIAGNOSES = _s(("CPR_hash", S), ("Diagnosekode", S), ("Noteret_dato", S), ("Løst_dato", S))
PATIENT_INFO = _s(("CPR_hash", S), ("Fødselsdato", S), ("Dødsdato", S), ("Køn", S))
VITALS = _s(("CPR_hash", S), ("Vital_parametre", S), ("Værdi", S), ("Værdi_Omregnet", S),
            ("Registreringstidspunkt", S))
LABS = _s(("CPR_hash", S), ("BestOrd", S), ("Resultatværdi", S), ("Prøvetagningstidspunkt", S))
ICU = _s(("CPR_hash", S), ("ITAOversigt_Måling", S), ("Værdi", S), ("Målingstidspunkt", S))
MEDICATION = _s(("CPR_hash", S), ("ATC", S), ("Handling", S), ("Administrationstidspunkt", S),
                ("Seponeringstidspunkt", S), ("Administrationsdosis", S))

RAW = {"Procedurer": PROCEDURES, "ADTHaendelser": ADT, "Cases": CASES, "Diagnoser": DIAGNOSES,
       "PatientInfo": PATIENT_INFO, "VitaleVaerdier": VITALS, "Labsvar": LABS,
       "ITAOversigtsrapport": ICU, "Medicin": MEDICATION}

LONG = _s(("PID", L), ("TIMESTAMP", TS), ("FEATURE", S), ("VALUE", S))
LONG_INTERVAL = _s(("PID", L), ("TIMESTAMP", TS), ("END_TIMESTAMP", TS), ("FEATURE", S), ("VALUE", S))
LONG_MULTI = _s(("PID", L), ("TIMESTAMP", TS), ("FEATURE", S), ("VALUE", ArrayType(S)))
BINS = _s(("PID", L), ("bin_start", TS), ("bin_end", TS), ("bin_counter", I), ("bin_freq", S))
PREDICTIONS = _s(("PID", L), ("y_true", I), ("y_pred", D), ("masking_point", S),
                 ("time_min", D), ("time_hours", D), ("time_days", D))

CATALOGUE = _s(("filename", S), ("dt_colname", S), ("value_colname", S), ("type_colname", S), ("ts_offset", I))

# The event catalogue (table, time column, value column, type
# column, slack days around the window).
CATALOGUE_ROWS = [
    ("ADTHaendelser", "Flyt_ind", "Afsnit", None, 0),
    ("Procedurer", "ServiceDatetime", "ProcedureCode", None, 1),
    ("Diagnoser", "Noteret_dato", "Diagnosekode", None, 1),
    ("VitaleVaerdier", "Registreringstidspunkt", "Værdi", None, 0),
    ("Medicin", "Administrationstidspunkt", "ATC", "Administrationsdosis", 0),
    ("Labsvar", "Prøvetagningstidspunkt", "Resultatværdi", "BestOrd", 0),
    ("Cases", "Operationshændelses_Tidspunkt", "SKS_Kode", "Operationshændelse", 0),
    ("ITAOversigtsrapport", "Målingstidspunkt", "Værdi", "ITAOversigt_Måling", 0),
    ("Notater", "Redigeringstidspunkt", "Note", "Notetype", 0),
    ("IndUd", "Målingstidspunkt", "Værdi", "Ind", 1),
    ("ITARespirator", "Målingstidspunkt", "Værdi", "ITAResp_Måling", 0),
    ("OP_haendelser", "Registreringstidspunkt", "Værdi", None, 0),
    ("OP_risiko", "Registreringstidspunkt", "Værdi", None, 0),
    ("OP_flow", "Registreringstidspunkt", "Værdi", None, 0),
    ("Intraskema_Haendelser", "Tidspunkt", "Hændelse", None, 0),
    ("EWS", "Målingstidspunkt", "Værdi", "EWS_Måling", 0),
    ("Mikrobiologi_Del1", "Provesvarstidspunkt", "Proveresultat", "Komponentnavn", 0),
    ("Mikrobiologi_Del2", "Provesvarstidspunkt", "Proveresultat", "Komponentnavn", 0),
    ("Mikrobiologi_Del3", "Provesvarsdato", "Proveresultat", "Organisme", 0),
]
