"""Quality rules judged per document and per host (native DataFrame functions only).

Per document: word, symbol, repeated-line and repeated-3-word-window counts.
Per host (``source``): the share of documents failing each rule, shrunk
towards an empirical beta prior fitted to all hosts by moments.  A document is
dropped if it fails a base rule or a severe rule, or if it fails the mild form
of a rule in a host whose shrunk failure rate for that rule is high.

Defined cases: a null or empty text has no words and fails the base rule; a
null host is a host of its own; repeated rows are judged one by one; an empty
table gives an empty result; extra columns are ignored.  Equal 3-word windows
are found by a 64-bit hash inside one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import SPACES, stage, text_or_empty, with_row_ids

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
HOST_RATE = 0.25      # shrunk failure rate from which a host is strict for a rule
HOST_SALTS = 64       # a hot host's documents are joined in so many parts
MAX_STRENGTH = 1e6    # prior strength if all hosts have the same rate

# rule -> (severe, mild): a document that fails either form counts for its host
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("100 * n_symbols > 10 * word_chars", "100 * n_symbols > 3 * word_chars"),
    "dup_lines": ("100 * n_dup_lines > 60 * n_lines", "100 * n_dup_lines > 30 * n_lines"),
    "repeats": ("100 * n_repeat_words > 50 * n_words", "100 * n_repeat_words > 35 * n_words"),
    "word_length": ("word_chars > 20 * n_words or word_chars < 2 * n_words",
                    "word_chars > 15 * n_words or word_chars < 3 * n_words"),
}


def _windows(w: Column) -> Column:
    return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))


def rule_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long).

    One projection per step, so that no array is computed twice; linear in the
    text but for one sort of the window hashes of texts with a repeat.
    """
    gaps = SPACES[1:]
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    a = docs.select(*keep, text_or_empty().alias("__t"))
    b = a.select(
        *keep,
        F.array_remove(F.split(F.translate("__t", gaps, " " * len(gaps)), " "), "").alias("__w"),
        lines.alias("__l"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    counted = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    c = b.select(
        *keep, F.size("__w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("__w")).alias("__g"))
    d = c.select(*counted, F.when(
        F.size(F.array_distinct("__g")) < F.size("__g"),
        F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"))
    s = F.col("__s")
    e = d.select(*counted, F.sort_array(F.transform(
        F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"])).alias("__p"))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                          F.lit(0), lambda acc, x: acc + x)
    return e.select(*counted, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """Too short, or over half of the words in repeated 3-word windows."""
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")


def host_verdicts(judged: DataFrame, host: str) -> DataFrame:
    """One row per host: shrunk failure rate and strict flag per rule.

    Beta prior by moments over the hosts' raw rates p: mean m, population
    variance v, strength m(1-m)/v - 1 held within 1 and MAX_STRENGTH; the
    shrunk rate is (failures + m * strength) / (documents + strength).
    """
    per = judged.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col(f"mild_{r}").cast("long")).alias(f"f_{r}") for r in RULES])
    prior = per.agg(*[f(F.col(f"f_{r}") / F.col("n")).alias(f"{k}_{r}")
                      for r in RULES for k, f in (("m", F.avg), ("v", F.var_pop))])
    row = prior.first().asDict()  # one row
    out = per.select(host, "n", *[f"f_{r}" for r in RULES])
    for r in RULES:
        m, v = row[f"m_{r}"] or 0.0, row[f"v_{r}"] or 0.0
        strength = min(MAX_STRENGTH, max(1.0, m * (1 - m) / v - 1)) if v > 0 else MAX_STRENGTH
        rate = (F.col(f"f_{r}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"strict_{r}", rate > HOST_RATE)
    return out


def judge(docs: DataFrame, host: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Counts, base_failed and kept per document row.

    The counts (no texts) are staged once; the host table is joined back by
    host and a salt taken from the id, so that a host with a third of all rows
    is spread over HOST_SALTS keys.
    """
    counts = rule_counts(docs.select(F.col(id_col).alias("__id"), F.col(host).cast("string").alias("__host"), "text"),
                         ["__id", "__host"])
    judged = counts.withColumn("base_failed", base_failed())
    for r, (severe, mild) in RULES.items():
        judged = judged.withColumn(f"severe_{r}", F.expr(severe)).withColumn(f"mild_{r}", F.expr(mild) | F.expr(severe))
    judged = stage(judged, "quality")
    hosts = (host_verdicts(judged, "__host")
             .select(F.col("__host").alias("__h"), *[f"strict_{r}" for r in RULES])
             .withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1)))))
    salted = judged.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(HOST_SALTS)).cast("int"))
    joined = salted.join(hosts, salted["__host"].eqNullSafe(hosts["__h"]) & (salted["__salt"] == hosts["__s"]), "left")
    bad = F.col("base_failed")
    for r in RULES:
        bad = bad | F.col(f"severe_{r}") | (F.col(f"mild_{r}") & F.coalesce(F.col(f"strict_{r}"), F.lit(False)))
    return joined.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", (~bad).alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; each row goes by its own verdict, whatever its id."""
    rows, row = with_row_ids(docs)
    bad = judge(rows, host, row).filter(~F.col("kept")).select(F.col(row).alias("__bad"))
    return rows.join(bad, rows[row] == bad["__bad"], "left_anti").select(*docs.columns)
