"""Wide per-patient dataset (K21) and many-cutoff features (M11 input)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefns import micros_sql
from ..operators.aggregates import WIDE_NUMERIC_AGGS, categorical_wide, clean_name, numeric_wide
from ..operators.filters import mask_after, member_filter, parse_masking_point
from ..operators.joins import guarded_left_join, semi_join_ids
from ..session import shuffle_partitions, worked_out_once


class AggregatedDataset:
    """Static columns of the base + every concept aggregated per PID.

    Per concept: PID semi join (J1) -> optional normaliser -> cutoff mask
    (P9/P10) -> drop listed features (P4) -> numeric (A1/R4) or categorical
    (A3) aggregation.  All concept frames are left-joined on PID (unique by
    construction) and nulls become 0.0.  A failing concept raises.
    """

    def __init__(self, cfg: dict, base: DataFrame, concepts: dict[str, DataFrame],
                 masking_point=None, agg_funcs: Sequence[str] = WIDE_NUMERIC_AGGS,
                 normalisers: dict | None = None, pivot_values: dict[str, list[str]] | None = None):
        self.cfg = cfg
        self.base = base
        self.concepts = concepts
        self.delta = parse_masking_point(masking_point) if not isinstance(masking_point, Column) else masking_point
        self.agg_funcs = list(agg_funcs)
        self.normalisers = normalisers or {}
        self.pivot_values = pivot_values or {}
        self.continuous_features: list[str] = []
        self.categorical_features: list[str] = []
        ds = cfg["dataset"]
        self.id_col = ds["id_col"]
        self.tab_cols = [c for c in ds.get("num_cols", []) + ds.get("cat_cols", []) if c in base.columns]
        self.continuous_features += [c for c in ds.get("num_cols", []) if c in base.columns]
        self.categorical_features += [c for c in ds.get("cat_cols", []) if c in base.columns]

    def _prepared(self, name: str, df: DataFrame) -> DataFrame:
        """The concept's long model: cohort only, normalised, masked, without dropped features."""
        d = semi_join_ids(df, self.base, self.id_col)
        if name in self.normalisers:
            d = d.transform(self.normalisers[name])
        if self.delta is not None:
            d = mask_after(d, self.base, self.delta, self.id_col)
        drops = self.cfg.get("drop_features", {}).get(name)
        if drops:
            d = member_filter(d, "FEATURE", drops, keep=False)
        return d.select(self.id_col, "TIMESTAMP", "FEATURE", "VALUE")

    def concept_frame(self, name: str, df: DataFrame) -> DataFrame | None:
        d = self._prepared(name, df)
        if name in self.cfg["dataset"].get("ts_cat_names", []):
            out, given, count = categorical_wide(d, name, self.pivot_values.get(name), self.id_col)
            self.categorical_features += given
            self.continuous_features += count
            return out
        out, names = numeric_wide(d, name, self.agg_funcs, self.pivot_values.get(name), self.id_col)
        self.continuous_features += names
        return out if names else None

    def build(self) -> DataFrame:
        target = self.cfg.get("target")
        keep = [self.id_col] + self.tab_cols + ([target] if target and target in self.base.columns else [])
        final = self.base.select(*dict.fromkeys(keep))
        for name, df in self.concepts.items():
            frame = self.concept_frame(name, df)
            if frame is not None:
                final = guarded_left_join(final, frame, self.id_col)
        return self._finished(final, [self.id_col, target])

    def build_runs(self, cutoffs_minutes: Sequence[int]) -> DataFrame:
        """M11 as runs of cutoffs: a row per PID and run of cutoffs between which
        none of its features changes, with the numbers of the run's first cutoff
        and of the one after its last (``first_cut``, ``next_cut``).

        The concepts are scanned, normalised and aggregated once for all cutoffs
        (:func:`cutoff_runs`); a pivot on (PID, cutoff) gives what changes there,
        and carrying it forward the state of all features.  What depends on the
        features alone (a model's score) is the same in all of a run, so it is
        worked out per run before :func:`at_cutoffs`.  Concepts need their list of
        columns in ``pivot_values``."""
        if self.delta is not None:
            raise ValueError("a dataset at many cutoffs takes no masking point of its own")
        target = self.cfg.get("target")
        cuts = sorted({int(c) for c in cutoffs_minutes})
        keep = dict.fromkeys([self.id_col] + self.tab_cols + ([target] if target and target in self.base.columns else []))
        # every PID has a state from the first cutoff on
        seen = self.base.where(F.col(self.id_col).isNotNull()).select(self.id_col).distinct().withColumn("first_cut", F.lit(0))
        cells, columns = [], []
        for k, (name, df) in enumerate(self.concepts.items()):
            d = self._prepared(name, df)
            categorical = name in self.cfg["dataset"].get("ts_cat_names", [])
            if categorical:
                d = d.where(F.col("VALUE").isNotNull()).withColumn("FEATURE", F.col("VALUE").cast("string")).withColumn("VALUE", F.lit(1))
            values = self.pivot_values[name]
            aggs = ["count"] if categorical else [a for a in self.agg_funcs if a in WIDE_NUMERIC_AGGS]
            runs = cutoff_runs(d, self.base, cuts, aggs, self.id_col).select(
                self.id_col, F.col("__s").alias("first_cut"), F.lit(k).alias("__k"), "FEATURE", *[F.col(a).alias(f"__v_{a}") for a in aggs])
            seen = seen.unionByName(runs, allowMissingColumns=True)
            cells += [F.max(F.when((F.col("__k") == k) & (F.col("FEATURE") == v), F.col(f"__v_{a}"))).alias(f"__{k}_{i}_{a}")
                      for i, v in enumerate(values) for a in aggs]
            if categorical:
                given = [f"{clean_name(v)}_{name}_given" for v in values]
                count = [f"{clean_name(v)}_{name}_count" for v in values]
                n = [F.coalesce(F.col(f"__{k}_{i}_count"), F.lit(0.0)).cast("bigint") for i in range(len(values))]
                columns += [x for g, c, v in zip(given, count, n) for x in ((v > 0).cast("bigint").alias(g), v.alias(c))]
                self.categorical_features += given
                self.continuous_features += count
            else:
                names = {f"{v}_{name}_{a}": F.col(f"__{k}_{i}_{a}") for i, v in enumerate(values) for a in aggs}
                columns += [F.coalesce(c, F.lit(0.0)).alias(n) for n, c in names.items()]
                self.continuous_features += list(names)
        # a PID's rows are few (one per cutoff and feature at most): dealt out by PID once for the pivot, the carrying and the join
        dealt = seen.repartition(shuffle_partitions(self.base.sparkSession), self.id_col)
        state = dealt.groupBy(self.id_col, "first_cut").agg(*cells) if cells else dealt.select(self.id_col, "first_cut").distinct()
        w = Window.partitionBy(self.id_col).orderBy("first_cut")
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        carried = [F.last(c, True).over(so_far).alias(c) for c in state.columns if c.startswith("__")]
        state = state.select(self.id_col, "first_cut", F.coalesce(F.lead("first_cut").over(w), F.lit(len(cuts))).alias("next_cut"), *carried)
        out = self.base.select(*keep).join(state, self.id_col, "left")  # a row without an id keeps all cutoffs
        out = out.select(*keep, F.coalesce("first_cut", F.lit(0)).alias("first_cut"),
                         F.coalesce("next_cut", F.lit(len(cuts))).alias("next_cut"), *columns)
        return self._finished(out, [self.id_col, target, "first_cut", "next_cut"])

    def build_at(self, cutoffs_minutes: Sequence[int]) -> DataFrame:
        """The dataset at many cutoffs, one row per (``masking_point`` in
        minutes, PID), with the columns that :meth:`build` has at one: the runs
        of :meth:`build_runs`, a row for each of their cutoffs."""
        return at_cutoffs(self.build_runs(cutoffs_minutes), cutoffs_minutes)

    def _finished(self, final: DataFrame, other: Sequence[str]) -> DataFrame:
        feats = [c for c in final.columns if c not in other]
        numeric = [c for c in feats if final.schema[c].dataType.typeName() in
                   ("double", "float", "integer", "long", "short", "decimal")]
        self.continuous_features = list(dict.fromkeys(self.continuous_features))
        self.categorical_features = list(dict.fromkeys(self.categorical_features))
        return final.fillna(0.0, subset=numeric)

    def features_by_type(self) -> tuple[list[str], list[str]]:
        """(continuous, categorical) column names."""
        return self.continuous_features, self.categorical_features


COMBINABLE_AGGS = ("first", "last", "mean", "min", "max", "std", "count", "sum")


def first_cutoff(offset_micros: str, cutoffs_minutes: Sequence[int]) -> Column:
    """Number of the first cutoff (sorted, in minutes) at or after an offset; their number when there is none.

    The cutoffs are split into runs of one step, and each run is one division."""
    cuts = [int(c) * 60_000_000 for c in cutoffs_minutes]
    runs, at = [], 0
    while at < len(cuts):
        to = at + 1
        while to + 1 < len(cuts) and cuts[to + 1] - cuts[to] == cuts[at + 1] - cuts[at]:
            to += 1
        to = min(to, len(cuts) - 1)
        step = max(1, cuts[to] - cuts[to - 1]) if to > at else 1
        runs.append(f"WHEN {offset_micros} <= {cuts[to]} THEN {at} + (greatest({offset_micros} - {cuts[at]}, 0) + {step - 1}) div {step}")
        at = to + 1
    return F.expr(f"CASE {' '.join(runs)} ELSE {len(cuts)} END").cast("int")


def at_cutoffs(runs: DataFrame, cutoffs_minutes: Sequence[int]) -> DataFrame:
    """A row per cutoff (``masking_point``, in minutes) of runs that have the
    numbers ``first_cut`` and ``next_cut`` (the one after the last)."""
    cuts = F.array(*[F.lit(c) for c in sorted({int(c) for c in cutoffs_minutes})])
    run = F.slice(cuts, F.col("first_cut") + 1, F.col("next_cut") - F.col("first_cut"))
    return runs.select(F.explode(run).alias("masking_point"), *[F.col("`" + c.replace("`", "``") + "`") for c in runs.columns
                                                               if c not in ("first_cut", "next_cut")])


def cutoff_features(long: DataFrame, base: DataFrame, cutoffs_minutes: Sequence[int], concept: str,
                    agg_funcs: Sequence[str] = ("last", "mean", "count"), id_col: str = "PID",
                    digits: int | None = None) -> DataFrame:
    """M11 input in one scan, long form ``(masking_point, PID, FEATURE,
    agg...)`` over the events with ``TIMESTAMP <= start + cutoff``: the runs of
    :func:`cutoff_runs`, a row for each of their cutoffs.  ``digits`` rounds the
    aggregates, once per run."""
    runs = cutoff_runs(long, base, cutoffs_minutes, agg_funcs, id_col)
    value = {a: F.col(a) if digits is None else F.round(a, digits).alias(a) for a in agg_funcs}
    runs = runs.select(id_col, "FEATURE", F.col("__s").alias("first_cut"), F.col("__next").alias("next_cut"), *value.values())
    return at_cutoffs(runs, cutoffs_minutes)


def cutoff_runs(long: DataFrame, base: DataFrame, cutoffs_minutes: Sequence[int],
                agg_funcs: Sequence[str] = ("last", "mean", "count"), id_col: str = "PID") -> DataFrame:
    """The aggregates over the events with ``TIMESTAMP <= start + cutoff``, as
    runs ``(PID, FEATURE, __s, __next, agg...)``: equal from cutoff number
    ``__s`` up to ``__next``, which is another run's.

    Each event is aggregated once, into the slot of the first cutoff that
    takes it; a running combine over the slots of (PID, FEATURE) -- at most
    one row per cutoff -- gives every cutoff's aggregate.  ``std`` adds the
    slots' squared deviations to those of their means, taken from the first
    slot's mean so that large values lose no digits.  ``median`` does not
    combine and is refused.  Events that carry their ``start`` need no join."""
    from ..functions.numeric import numeric_column
    cuts = sorted({int(c) for c in cutoffs_minutes})
    j = long if "start" in long.columns else long.join(base.select(id_col, "start"), id_col, "inner")
    order = F.struct("TIMESTAMP", "__v")
    parts = {"first": F.min(order), "last": F.max(order), "total": F.sum("__v"), "min": F.min("__v"), "max": F.max("__v"),
             "n": F.count("__v"), "m2": F.var_pop("__v") * F.count("__v")}
    needs = {"first": ["first"], "last": ["last"], "mean": ["total", "n"], "min": ["min"], "max": ["max"],
             "count": ["n"], "sum": ["total"], "std": ["total", "n", "m2"]}
    if unknown := [a for a in agg_funcs if a not in needs]:
        raise ValueError(f"{', '.join(unknown)} cannot be combined over cutoffs")
    used = list(dict.fromkeys(p for a in agg_funcs for p in needs[a]))
    slots = j.withColumn("__v", numeric_column(long, "VALUE")).where(F.col("__v").isNotNull()) \
             .withColumn("__gap", F.expr(micros_sql("start", "TIMESTAMP"))).withColumn("__s", first_cutoff("__gap", cuts)) \
             .transform(worked_out_once, "__s").where(F.col("__s") < len(cuts)).groupBy(id_col, "FEATURE", "__s").agg(*[parts[p].alias(f"__{p}") for p in used]) \
             .repartition(shuffle_partitions(long.sparkSession), id_col)  # at most a row per feature and cutoff of an id
    w = Window.partitionBy(id_col, "FEATURE").orderBy("__s")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    if "std" in agg_funcs:
        mean = F.col("__total") / F.col("__n")
        slots = slots.withColumn("__d", mean - F.first(mean).over(so_far))
    combine = {"first": F.min, "last": F.max, "total": F.sum, "min": F.min, "max": F.max, "n": F.sum, "m2": F.sum}
    columns = [combine[p](f"__{p}").over(so_far).alias(f"__{p}") for p in used]
    if "std" in agg_funcs:
        columns += [F.sum(F.col("__n") * F.col("__d")).over(so_far).alias("__nd"),
                    F.sum(F.col("__n") * F.col("__d") * F.col("__d")).over(so_far).alias("__ndd")]
    run = slots.select(id_col, "FEATURE", "__s", F.coalesce(F.lead("__s").over(w), F.lit(len(cuts))).alias("__next"), *columns)
    out = {"first": "__first.__v", "last": "__last.__v", "min": "__min", "max": "__max", "count": "__n", "sum": "__total"}
    value = {a: F.col(out[a]) for a in agg_funcs if a in out}
    value["mean"] = F.col("__total") / F.col("__n")
    spread = F.col("__m2") + F.col("__ndd") - F.col("__nd") * F.col("__nd") / F.col("__n")
    value["std"] = F.when(F.col("__n") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("__n") - 1)))
    return run.select(id_col, "FEATURE", "__s", "__next", *[value[a].cast("double").alias(a) for a in agg_funcs])
