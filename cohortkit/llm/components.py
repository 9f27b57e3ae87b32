"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import stage


ROWS_PER_FILE = 500_000


def _parts(rows: int) -> int:
    """Files for a table of so many links; small tables of a long loop stay in a few."""
    return rows // ROWS_PER_FILE + 4


def _star(links: DataFrame, large: bool, parts: int) -> DataFrame:
    """Links (u, v) to (larger end, smallest neighbour).

    The smallest neighbour comes from a map-side combined minimum that is
    staged and joined back, so a centre with many links is split like any
    skewed join, never gathered.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter(F.col("v") < F.col("u"))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("c"), F.least("m", "u").alias("m")).coalesce(parts), "star")
    near = both.join(least, both["u"] == least["c"])
    if large:
        out = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select("v", "m").unionByName(least.select(F.col("c").alias("v"), "m")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
    return stage(out.filter(F.col("u") > F.col("v")).distinct().coalesce(parts), "links")


def _digest(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (u, v); the component is its smallest id."""
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .filter(F.col("u") > F.col("v")).distinct().coalesce(_parts(links.count())), "links")
    before = _digest(links)
    while before[0]:
        links = _star(_star(links, True, _parts(before[0])), False, _parts(before[0]))
        now = _digest(links)
        if now == before:
            break
        before = now
    tops = links.select(F.col("v").alias("id")).distinct()
    return (links.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(tops.select("id", F.col("id").alias("component"))))
