"""URL filter as a sort-merge range join of reversed-host keys with rule intervals.

A host is written with its labels reversed and a dot after each
(``blog.a.org`` -> ``org.a.blog.``), so "this host and all its subdomains" is
the interval of keys that start with the rule's key.  URLs are dealt into
ranges of (key, path, id) by sampled splitters; a rule goes to every range
that its interval meets.  In a range one sorted sweep keeps a stack of the
open, nested rule hosts; a URL takes the longest rule on the stack whose path
starts its own.

Longest: host and path together, then the longer host, then ``block``.
Defined cases: null and any text without ``://`` have an empty host and path
and meet no rule; the verdict without a rule is ``default``; repeated rows are
judged one by one; a repeated rule counts once; empty tables give empty
results or the default verdict; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.common import ascii_lower, shuffle_parts

SAMPLE_PER_RANGE = 40    # sampled keys for each range; bounds what the driver holds
LAST = "\U0010ffff"      # above any character of a key

RULES = [  # host, path, verdict
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path columns of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _splitters(keys: DataFrame, parts: int) -> list[tuple[str, str]]:
    """At most ``parts - 1`` sampled (key, path) bounds; they only balance the ranges."""
    n = keys.count()
    want = parts * SAMPLE_PER_RANGE
    if n == 0 or parts < 2:
        return []
    got = sorted((r[0], r[1]) for r in keys.sample(min(1.0, want / n), seed=7).limit(4 * want).collect())
    return sorted({got[len(got) * i // parts] for i in range(1, parts)}) if got else []


def _sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Rows of one partition, sorted by (range, key, kind, path)."""
    stack: list[tuple[str, list]] = []
    now = None
    for batch in batches:
        out = []
        for part, key, kind, path, pid, host, verdict in zip(
                batch["part"], batch["key"], batch["kind"], batch["path"], batch["page_id"], batch["host"],
                batch["verdict"]):
            if part != now:
                now, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((host, path, verdict))
                continue
            best = None
            for _, rules in stack:
                for h, p, v in rules:
                    if path.startswith(p):
                        rank = (len(h) + len(p), len(h), v == "block")
                        if best is None or rank > best[0]:
                            best = (rank, h + p, v)
            out.append((pid, host, path, best[1] if best else None, best[2] if best else default))
        yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """id, host, path, rule (null if none) and verdict of every row."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = (pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
            .withColumn("key", host_key(F.col("host"))))
    parts = shuffle_parts(pages.sparkSession)
    cuts = _splitters(urls.select("key", "path"), parts)
    salts = max(1, parts)

    @F.pandas_udf("int")
    def place(key: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x) for x in zip(key, path)], dtype="int32")

    @F.pandas_udf("struct<a:int,b:int>")
    def cover(key: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"a": [bisect_left(cuts, (k, "")) for k in key],
                             "b": [bisect_right(cuts, (k + LAST, LAST)) for k in key]}).astype("int32")

    # A (key, path) that alone fills more than a range repeats among the splitters' sample; it is
    # spread over sub-ranges by the id, and rules go to each sub-range.
    sub = 4 if salts > 4 else 1
    placed = urls.select(
        (place("key", "path") * sub + F.pmod(F.xxhash64("page_id"), F.lit(sub)).cast("int")).alias("part"),
        "key", F.lit(1).alias("kind"), "path", "page_id", "host", F.lit(None).cast("string").alias("verdict"))
    opened = (rules.select("host", "path", "verdict").dropna().distinct()
              .withColumn("host", ascii_lower(F.col("host"))).withColumn("key", host_key(F.col("host")))
              .withColumn("c", cover("key"))
              .withColumn("part", F.explode(F.sequence(F.col("c.a") * sub, F.col("c.b") * sub + (sub - 1)))))
    events = placed.unionByName(opened.select(
        "part", "key", F.lit(0).alias("kind"), "path", F.lit(None).cast(placed.schema["page_id"].dataType).alias("page_id"),
        "host", "verdict"))
    ordered = events.repartition(parts, "part").sortWithinPartitions("part", "key", "kind", "path")
    id_type = placed.schema["page_id"].dataType.simpleString()
    return ordered.mapInPandas(lambda it: _sweep(it, default),
                               f"page_id {id_type}, host string, path string, rule string, verdict string"
                               ).withColumnRenamed("page_id", id_col)
