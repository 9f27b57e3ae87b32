"""Registered queries, part 6: small operators as queries of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import first_non_null_per_column
from ..operators.filters import (align_frames, duration_seconds, fill_window_from_date, keyword_flags, mask_after, missing_keys,
                                 preop_cutoff, split_xy)
from ..session import ensure_checkpoint_dir
from ..sources.readers import collect_subsets, read_base, read_csv
from ..sources.sinks import write_features, write_summary
from . import driver_tables as dt
from .catalog import SQL_BASE, SQL_WLONG, base, r6, register, windowed_long
from .models import fit_preprocessor
from .split import train_test_split

W = dt.with_sql


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- S6: every configured table restricted to the cohort and stored; stored ones are skipped -------------------------
def s6_collect_subsets(spark: SparkSession, sf: str) -> DataFrame:
    ids = dt.read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    root = _scratch(spark, "subsets")
    done = collect_subsets(spark, ["orders", "orders"], sf, ids, root, id_col="o_custkey")
    again = collect_subsets(spark, ["orders"], sf, ids, root, id_col="o_custkey")
    out = spark.read.parquet(f"{root}/orders.parquet")
    return out.select("o_orderkey", "o_custkey", F.lit(len(done)).alias("n_stored"), F.lit(len(again)).alias("n_again"))


register("s6_collect_subsets", """
SELECT o_orderkey, o_custkey, 1 AS n_stored, 0 AS n_again FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")(s6_collect_subsets)


# -- S10 / S2 / S14: a feature matrix stored as CSV and Parquet and read back ------------------------------------------
def s10_feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    f = dt.read(spark, sf, "events").groupBy(F.col("user_id").alias("PID")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("value").cast("double")).alias("top"))
    root = _scratch(spark, "features")
    write_features(f, f"{root}/csv", "csv")
    write_features(f, f"{root}/parquet")
    csv = read_csv(spark, f"{root}/csv", f.schema)
    return read_base(spark, f"{root}/parquet").join(csv.select("PID", F.col("top").alias("top_csv")), "PID")


register("s10_feature_matrix", """
SELECT user_id AS PID, count(*) AS n, max(value) AS top, max(value) AS top_csv FROM events GROUP BY user_id""")(s10_feature_matrix)


# -- S13: a summary of one row per group, written as one small file ---------------------------------------------------
def s13_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = dt.read(spark, sf, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n_toxic")).collect()
    path = _scratch(spark, "summary")
    write_summary(spark, [{"quality": int(r.quality), "n": int(r.n), "n_toxic": int(r.n_toxic)} for r in rows], path)
    return spark.read.schema("n long, n_toxic long, quality long").option("header", True).csv(path)


register("s13_summary", """
SELECT CAST(quality AS BIGINT) AS quality, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS n_toxic FROM labels GROUP BY quality""")(s13_summary)


# -- P10: a mask by a duration text of days and a clock --------------------------------------------------------------------
P10_TEXT = "1 days 02:30:00"


def p10_duration_mask(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    return mask_after(windowed_long(spark, sf, b), b, P10_TEXT).groupBy("PID").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("seconds", F.lit(duration_seconds(P10_TEXT)))


register("p10_duration_mask", W(dt.SQL_ADT, SQL_BASE, SQL_WLONG) + """
SELECT w.PID, count(*) AS n, CAST(95400 AS DOUBLE) AS seconds FROM wlong w JOIN base b ON w.PID = b.PID
WHERE w."TIMESTAMP" <= b.start + INTERVAL 26 HOUR + INTERVAL 30 MINUTE GROUP BY w.PID""")(p10_duration_mask)


# -- P12: keyword hits with their time half ---------------------------------------------------------------------------------
def p12_keywords_in_time(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose text names a purchase or an error, and whether that was within six hours of the user's first event."""
    ev = dt.read(spark, sf, "events")
    first = ev.groupBy("user_id").agg(F.min("ts").alias("t0"))
    d = ev.select("event_id", "user_id", F.concat(F.lit("the "), F.upper("event_type"), F.lit(" of "), "props").alias("note"), "ts").join(first, "user_id")
    return keyword_flags(d, "note", ["purchase", "error"], "hit", "ts", "t0", hours=6).select("event_id", "hit", "hit_within")


register("p12_keywords_in_time", """
WITH f AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events)
SELECT event_id, event_type IN ('purchase', 'error') AS hit,
       event_type IN ('purchase', 'error') AND ts <= t0 + INTERVAL 6 HOUR AS hit_within FROM f WHERE props IS NOT NULL
UNION ALL SELECT event_id, false, false FROM f WHERE props IS NULL""")(p12_keywords_in_time)


# -- P11 / P14: exclusion before the split, features and target apart -------------------------------------------------------
def p11_split_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    o = dt.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("PID"), F.col("o_orderdate").cast("timestamp_ntz").alias("ServiceDate"), (F.col("o_custkey") % 2).alias("LVL1TC"),
        F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("target"))
    cfg = {"holdout_type": "temporal", "holdout_split_date": "1995-06-17", "dataset": {"id_col": "PID", "exclusion": "lvl1tc"}}
    parts = []
    for name, part in zip(("train", "holdout"), train_test_split(cfg, o)):
        x, y = split_xy(part, "target", "PID", include_id=True)
        parts.append(x.join(y, "PID").select("PID", r6("price").alias("price"), "target", F.lit(name).alias("part")))
    return parts[0].unionByName(parts[1])


register("p11_split_exclusion", """
SELECT o_orderkey AS PID, round(o_totalprice, 6) AS price, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
       CASE WHEN CAST(o_orderdate AS TIMESTAMP) <= TIMESTAMP '1995-06-17' THEN 'train' ELSE 'holdout' END AS part
FROM orders WHERE o_custkey % 2 = 1 AND o_orderdate IS NOT NULL""")(p11_split_exclusion)


# -- P13: two weekly frames brought to the same columns ----------------------------------------------------------------------
def p13_align_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Event counts by day of week of two halves of the users; each half lacks some days' columns."""
    ev = dt.read(spark, sf, "events").select(F.col("user_id").alias("PID"), F.dayofweek("ts").alias("d"))

    def half(rest: int, days: list[int]) -> DataFrame:
        return ev.where(F.col("PID") % 2 == rest).groupBy("PID").pivot("d", days).agg(F.count(F.lit(1)).cast("double"))
    a, b = align_frames(half(0, [1, 2, 3, 10]), half(1, [3, 4, 2]))
    assert a.columns == b.columns == ["PID", "1", "2", "3", "4", "10"]
    return a.unionByName(b).select("PID", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"d{c}") for c in a.columns[1:]])


register("p13_align_frames", "SELECT user_id AS PID, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE dayofweek(ts) + 1 = {d} AND user_id % 2 {p}) AS DOUBLE) AS d{d}"
    for d, p in ((1, "= 0"), (2, ">= 0"), (3, ">= 0"), (4, "= 1"), (10, "= 0"))) + " FROM events GROUP BY user_id")(p13_align_frames)


# -- P16 / P17: windows filled from the index date, the preoperative cutoff ----------------------------------------------------
def p16_p17_windows(spark: SparkSession, sf: str) -> DataFrame:
    o = dt.read(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("ServiceDate"), F.col("o_orderkey").alias("k"))
    day = lambda n: F.col("ServiceDate") + F.make_interval(days=F.lit(n))
    d = o.select("o_orderkey", "ServiceDate", F.when(F.col("k") % 3 != 0, day(-1)).alias("start"), F.when(F.col("k") % 4 != 0, day(2)).alias("end"),
                 F.when(F.col("k") % 5 == 0, day(1)).alias("knife_time"), F.when(F.col("k") % 2 == 0, day(0)).alias("ServiceDatetime_1"))
    d = fill_window_from_date(d)
    return d.select("o_orderkey", "start", "end", preop_cutoff(d).alias("cutoff"))


register("p16_p17_windows", """
WITH o AS (SELECT o_orderkey, o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders)
SELECT o_orderkey, CASE WHEN k % 3 <> 0 THEN d - INTERVAL 1 DAY ELSE d END AS start, CASE WHEN k % 4 <> 0 THEN d + INTERVAL 2 DAY ELSE d END AS "end",
       CASE WHEN k % 5 = 0 THEN d + INTERVAL 1 DAY ELSE d END AS cutoff FROM o""")(p16_p17_windows)


# -- A8: the first value of each column on its own --------------------------------------------------------------------------------
def a8_first_values(spark: SparkSession, sf: str) -> DataFrame:
    ev = dt.read(spark, sf, "events")
    d = ev.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("first_purchase"),
                  F.when(F.col("event_type") == "error", F.col("event_id")).alias("first_error"))
    return first_non_null_per_column(d, ["user_id"], ["ts", "event_id"], ["first_purchase", "first_error"])


register("a8_first_values", """
SELECT user_id, arg_min(value, struct_pack(t := ts, e := event_id)) FILTER (WHERE event_type = 'purchase' AND value IS NOT NULL) AS first_purchase,
       arg_min(event_id, struct_pack(t := ts, e := event_id)) FILTER (WHERE event_type = 'error') AS first_error
FROM events GROUP BY user_id""")(a8_first_values)


# -- U3: customers without a pending order --------------------------------------------------------------------------------------------------
def u3_missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = dt.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return missing_keys(c, dt.read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), ["k"])


register("u3_missing_keys", "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")(
    u3_missing_keys)


# -- M1: imputed, ordinal-coded and standardised features, fitted on one part and applied to all -------------------------------------
def m1_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    o = dt.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("PID"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"))
    model = fit_preprocessor(o.where("PID % 3 = 0 AND (priority IS NULL OR priority <> '5-LOW')"), ["priority"], ["price"], scale=True)
    return model.transform(o).select("PID", F.col("__ord_priority").alias("priority"), r6("__num_price").alias("price"))


register("m1_preprocess", """
WITH o AS (SELECT o_orderkey AS PID, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS c,
                  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS x FROM orders),
tr AS (SELECT * FROM o WHERE PID % 3 = 0 AND (c IS NULL OR c <> '5-LOW')),
st AS (SELECT (SELECT c FROM tr WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) AS m, avg(x) AS a, stddev_pop(x) AS s FROM tr),
cd AS (SELECT c, CAST(row_number() OVER (ORDER BY c) - 1 AS DOUBLE) AS i FROM (SELECT DISTINCT coalesce(c, (SELECT m FROM st)) AS c FROM tr))
SELECT PID, coalesce(cd.i, -1.0) AS priority, round((coalesce(o.x, a) - a) / s, 6) AS price
FROM o CROSS JOIN st LEFT JOIN cd ON cd.c = coalesce(o.c, m)""")(m1_preprocess)
