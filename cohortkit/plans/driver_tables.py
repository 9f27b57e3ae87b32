"""Clinical-shaped inputs derived from the driver tables.

The clinical tables (ADT moves, procedures, diagnoses, labs, ...) do not
exist in the test data, so each registered query first derives one from
the given tables -- every row of the source table feeds it, so the work
grows with the data.  Each adapter exists twice: as a DataFrame function
and as a SQL CTE for the DuckDB oracle; both must stay identical.

Mapping (test fixture, our own invention):
  * patient            = ``events.user_id`` (``CPR_hash`` as text)
  * ADT move           = an event: in ``ts``, out ``ts + value minutes``;
                         ``signup`` = admission, ``view`` = "Flyt Ind"
  * department name    = fixed list indexed by ``props.k % 10``
  * procedure          = a ``purchase`` event, code by ``k % 6``
  * lab / vital result = an event rendered as text in clinical formats
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import worked_out_once

# Fixture values (ours): department names, procedure codes, lab names,
# vital names, diagnosis codes and ATC codes / actions used to dress the
# driver events as clinical rows.  Indexed by props.k modulo the list size.
DEPARTMENTS = [
    "RH TRAUMECENTER", "HGH OPERATIONSGANG", "SJ HOLBÆK INTENSIV", "AHH SENGEAFSNIT 2",
    "BFH AMBULATORIUM", "RH ITA 1", "NOH KØKKEN", "SJ ROSKILDE Øjenklinik operation",
    "hgh dagkirurgi", "RH, BEDØVELSE OG OPERATION",
]
PROCEDURE_CODES = ["KJJA96", "KJJB00", "KJJW96", "KNHJ63", "KJDH70", "KJJA50"]
LAB_NAMES = ["LAKTAT;P(AB)", "HÆMOGLOBIN;B", "LEUKOCYTTER;B", "TEG-R", "BASE EXCESS;ECV", "KALIUM;P", "TEG-MA"]
VITAL_NAMES = ["BT", "Puls", "Saturation", "Temp.", "Resp.frekvens", "Højde", "Vægt", "NIBP", "ART mean inv BT"]
DIAGNOSIS_CODES = ["DI219", "DC221A", "DE119", "DJ449", "DI500", "DK703", "DC780", "DF329", "DN189", "DE669",
                   "DI10", "DB20"]
ATC_CODES = ["J01CA04", "N02AB03", "C03CA01", "B01AC06", "B05BB01", "Z99", "N01AX10", "A10AB05"]
MED_ACTIONS = ["Administreret", "Ny pose", "Seponeret", "Selvmedicinering"]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of a named table (schema from the file footer)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), ((idx % len(values)) + 1).cast("int"))


def _sql_pick(values: list[str], idx: str) -> str:
    arr = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{arr}])[({idx}) % {len(values)} + 1]"


def prop_k(col: str = "props") -> F.Column:
    return F.get_json_object(F.col(col), "$.k").cast("int")


SQL_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
SQL_END = "ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT))"


def end_ts() -> F.Column:
    return F.expr("timestampadd(MICROSECOND, CAST(round(value * 60000000) AS BIGINT), ts)")


# -- ADT moves --------------------------------------------------------------
def adt(events: DataFrame) -> DataFrame:
    k = prop_k()
    return events.select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("CPR_hash"),
        F.when(F.col("event_type") == "signup", "Indlæggelse")
         .when(F.col("event_type") == "view", "Flyt Ind")
         .otherwise(F.col("event_type")).alias("ADT_haendelse"),
        F.col("ts").alias("Flyt_ind"),
        end_ts().alias("Flyt_ud"),
        _pick(DEPARTMENTS, k).alias("Afsnit"))


SQL_ADT = f"""adt AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS CPR_hash,
         CASE WHEN event_type = 'signup' THEN 'Indlæggelse' WHEN event_type = 'view' THEN 'Flyt Ind'
              ELSE event_type END AS ADT_haendelse,
         ts AS Flyt_ind, {SQL_END} AS Flyt_ud,
         {_sql_pick(DEPARTMENTS, SQL_K)} AS Afsnit
  FROM events)"""


# -- procedures (population seed) --------------------------------------------
def procedures(events: DataFrame) -> DataFrame:
    k = prop_k()
    return events.where(F.col("event_type") == "purchase").select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("CPR_hash"),
        _pick(PROCEDURE_CODES, k).alias("ProcedureCode"),
        F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("ServiceDate"),
        F.col("ts").alias("ServiceDatetime"))


SQL_PROC = f"""proc AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS CPR_hash,
         {_sql_pick(PROCEDURE_CODES, SQL_K)} AS ProcedureCode,
         date_trunc('day', ts) AS ServiceDate, ts AS ServiceDatetime
  FROM events WHERE event_type = 'purchase')"""


# -- long model of raw events --------------------------------------------------
def long_model(events: DataFrame) -> DataFrame:
    """Events renamed into ``(PID, TIMESTAMP, FEATURE, VALUE)``."""
    return events.select(F.col("user_id").alias("PID"), F.col("ts").alias("TIMESTAMP"),
                         F.col("event_type").alias("FEATURE"), F.col("value").alias("VALUE"))


# -- labs as clinical text -----------------------------------------------------
def labs_raw(events: DataFrame) -> DataFrame:
    """Lab rows: name by k, result text in mixed formats (``<0,5``,
    ``3.2*``, ``>12``, ``neg``) chosen by event_id."""
    k = prop_k()
    v = F.format_string("%.2f", F.col("value"))
    fmt = F.col("event_id") % 5
    text = (F.when(fmt == 0, F.concat(F.lit("<"), F.translate(v, ".", ",")))
             .when(fmt == 1, F.concat(v, F.lit("*")))
             .when(fmt == 2, F.concat(F.lit("> "), v))
             .when(fmt == 3, F.lit("neg"))
             .otherwise(v))
    labs = events.select(F.col("event_id"), F.col("user_id").cast("string").alias("CPR_hash"),
                         _pick(LAB_NAMES, k).alias("BestOrd"), text.alias("Resultatværdi"),
                         F.col("ts").alias("Prøvetagningstidspunkt"))
    return worked_out_once(labs, "BestOrd", "Resultatværdi")


SQL_LABS = f"""labs_raw AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS CPR_hash,
         {_sql_pick(LAB_NAMES, SQL_K)} AS BestOrd,
         CASE event_id % 5 WHEN 0 THEN '<' || replace(printf('%.2f', value), '.', ',')
                           WHEN 1 THEN printf('%.2f', value) || '*'
                           WHEN 2 THEN '> ' || printf('%.2f', value)
                           WHEN 3 THEN 'neg'
                           ELSE printf('%.2f', value) END AS "Resultatværdi",
         ts AS "Prøvetagningstidspunkt"
  FROM events)"""


def with_sql(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


# -- diagnoses, vitals, medication, patient info -------------------------------
def diagnoses(events: DataFrame) -> DataFrame:
    """Diagnosis rows from ``error`` events: code by k, noted k*5 days
    before the event, resolved k%40 days after (unresolved when k%3==0)."""
    events = worked_out_once(events.where(F.col("event_type") == "error").withColumn("k", prop_k()), "k")
    k = F.col("k")
    return events.select(
        F.col("event_id"), F.col("user_id").cast("string").alias("CPR_hash"),
        _pick(DIAGNOSIS_CODES, k).alias("Diagnosekode"),
        (F.col("ts") - F.make_interval(days=k * 5)).alias("Noteret_dato"),
        F.when(k % 3 != 0, F.col("ts") + F.make_interval(days=k % 40)).alias("Løst_dato"))


SQL_DIAG = f"""diag AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS CPR_hash, {_sql_pick(DIAGNOSIS_CODES, SQL_K)} AS Diagnosekode,
         ts - to_days({SQL_K} * 5) AS Noteret_dato,
         CASE WHEN {SQL_K} % 3 <> 0 THEN ts + to_days({SQL_K} % 40) END AS "Løst_dato"
  FROM events WHERE event_type = 'error')"""


def vitals(events: DataFrame) -> DataFrame:
    """Vital rows: name by k; BP names carry ``sys/dia`` text; Temp. has a
    converted column."""
    events = worked_out_once(events.withColumn("name", _pick(VITAL_NAMES, prop_k())), "name")
    name = F.col("name")
    v = F.format_string("%.2f", F.col("value"))
    bp = F.concat(F.round(F.col("value")).cast("bigint").cast("string"), F.lit("/"),
                  F.round(F.col("value") / 2).cast("bigint").cast("string"))
    return events.select(F.col("event_id"), F.col("user_id").alias("PID"),
                         F.col("user_id").cast("string").alias("CPR_hash"),
                         name.alias("Vital_parametre"),
                         F.when(name.isin("BT", "NIBP"), bp).otherwise(v).alias("Værdi"),
                         F.format_string("%.2f", F.col("value") + 30).alias("Værdi_Omregnet"),
                         F.col("ts").alias("Registreringstidspunkt"))


SQL_VITALS = f"""vit AS (
  SELECT event_id, user_id AS PID, CAST(user_id AS VARCHAR) AS CPR_hash,
         {_sql_pick(VITAL_NAMES, SQL_K)} AS Vital_parametre,
         CASE WHEN {_sql_pick(VITAL_NAMES, SQL_K)} IN ('BT', 'NIBP')
              THEN CAST(CAST(round(value) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(round(value / 2) AS BIGINT) AS VARCHAR)
              ELSE printf('%.2f', value) END AS "Værdi",
         printf('%.2f', value + 30) AS "Værdi_Omregnet",
         ts AS Registreringstidspunkt
  FROM events)"""


def medication(events: DataFrame) -> DataFrame:
    events = worked_out_once(events.withColumn("k", prop_k()), "k")
    return events.select(F.col("event_id"), F.col("user_id").alias("PID"),
                         _pick(ATC_CODES, F.col("k")).alias("ATC"), _pick(MED_ACTIONS, F.col("event_id")).alias("Handling"),
                         F.col("ts").alias("Administrationstidspunkt"), end_ts().alias("Seponeringstidspunkt"))


SQL_MED = f"""med AS (
  SELECT event_id, user_id AS PID, {_sql_pick(ATC_CODES, SQL_K)} AS ATC,
         {_sql_pick(MED_ACTIONS, 'event_id')} AS Handling,
         ts AS Administrationstidspunkt, {SQL_END} AS Seponeringstidspunkt
  FROM events)"""


def patient_info(customer: DataFrame) -> DataFrame:
    """Demographics from customer rows (customer key = patient id)."""
    ck = F.col("c_custkey")
    return customer.select(
        ck.cast("string").alias("CPR_hash"),
        (F.lit("1930-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(days=(ck * 7919) % 25000)).alias("DOB"),
        F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
               + F.make_interval(days=(ck * 31) % 60, hours=ck % 24)).alias("DOD"),
        F.when(ck % 2 == 0, "Mand").otherwise("Kvinde").alias("SEX_RAW"))


SQL_PINFO = """pinfo AS (
  SELECT CAST(c_custkey AS VARCHAR) AS CPR_hash,
         TIMESTAMP '1930-01-01 00:00:00' + to_days(CAST((c_custkey * 7919) % 25000 AS INTEGER)) AS DOB,
         CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-01 00:00:00'
              + to_days(CAST((c_custkey * 31) % 60 AS INTEGER)) + to_hours(CAST(c_custkey % 24 AS BIGINT)) END AS DOD,
         CASE WHEN c_custkey % 2 = 0 THEN 'Mand' ELSE 'Kvinde' END AS SEX_RAW
  FROM customer)"""


# -- ICU scores, cases, procedure categories -----------------------------------
ICU_NAMES = ["GLASGOW COMA SCORE", "SAPS 3 SCORE", "SOFA total score", "Glasgow Coma Score", "RASS"]
# Fixture catalogue for the procedure normaliser (category -> codes).
PROCEDURE_CATEGORIES = {"abdominal_major": ["KJJA96", "KJJB00", "KJJW96", "KJJA50", "KNHJ63", "KJDH70"]}


def ita(events: DataFrame) -> DataFrame:
    k = prop_k()
    return events.select(F.col("event_id"), F.col("user_id").alias("PID"), _pick(ICU_NAMES, k).alias("ITAOversigt_Måling"),
                         F.format_string("%.2f", F.col("value")).alias("Værdi"), F.col("ts").alias("Målingstidspunkt"))


SQL_ITA = f"""ita AS (
  SELECT event_id, user_id AS PID, {_sql_pick(ICU_NAMES, SQL_K)} AS "ITAOversigt_Måling",
         printf('%.2f', value) AS "Værdi", ts AS "Målingstidspunkt" FROM events)"""


def cases(events: DataFrame) -> DataFrame:
    """Operation events: ``click`` = knife start (completed unless k%4==0),
    ``view`` = last suture; case = patient and day of month."""
    k = prop_k()
    case = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.dayofmonth("ts").cast("string"))
    ev = events.where(F.col("event_type").isin("click", "view"))
    return ev.select(F.col("user_id").cast("string").alias("CPR_hash"), case.alias("Case_ID"),
                     F.lit("KJJA96").alias("SKS_Kode"),
                     F.when(F.col("event_type") == "click", "Knivtid/procedure start")
                      .otherwise("Sidste sutur/procedure slut").alias("Operationshændelse"),
                     F.col("ts").alias("Operationshændelses_Tidspunkt"),
                     F.when(F.col("event_type") == "click",
                            F.when(k % 4 == 0, "Aflyst").otherwise("Fuldført")).alias("Status"))


SQL_CASES = f"""cases AS (
  SELECT CAST(user_id AS VARCHAR) AS CPR_hash, CAST(user_id AS VARCHAR) || '-' || CAST(day(ts) AS VARCHAR) AS Case_ID,
         CASE WHEN event_type = 'click' THEN 'Knivtid/procedure start' ELSE 'Sidste sutur/procedure slut' END
           AS "Operationshændelse",
         ts AS "Operationshændelses_Tidspunkt",
         CASE WHEN event_type = 'click' THEN CASE WHEN {SQL_K} % 4 = 0 THEN 'Aflyst' ELSE 'Fuldført' END END AS Status
  FROM events WHERE event_type IN ('click', 'view'))"""


def patient_info_raw(customer: DataFrame) -> DataFrame:
    """Demographics in the raw clinical column names (text dates)."""
    p = patient_info(customer)
    return p.select("CPR_hash", F.col("DOB").cast("string").alias("Fødselsdato"),
                    F.col("DOD").cast("string").alias("Dødsdato"), F.col("SEX_RAW").alias("Køn"))
