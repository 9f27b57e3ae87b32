"""Hierarchical time-bin grid (G1, K15, K16, W8, S12) and bin assignment
(J6 interval overlap, J8 half-open / J9 closed point-in-bin).

The grid is relative to each trajectory start: interval ``i`` holds bins of
size ``f_i`` from the last edge of interval ``i-1``; edges lie strictly below
``min(start + interval_end, end + 10 min)`` and the last partial bin of each
interval is dropped.  With non-decreasing bin sizes the grid is the same for
every trajectory, cut where ``bin_end >= end + 10 min``.  So the grid is a
handful of segments computed once from the config, and every bin question is
*arithmetic on the offset from start*: generating bins is one ``explode``
(no join), and placing an event in its bin needs only the trajectory row of
its PID -- never a join against the (large) bin table.  Other configs have a
column per interval for its first edge in each trajectory and answer the same
questions by comparing the offset with these.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefns import micros_sql
from ..session import shuffle_partitions, worked_out_once

US = {"s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}

# Fixed value: the window end is the trajectory end plus ten minutes.
WINDOW_SLACK_US = 10 * 60_000_000


def parse_duration_us(text: str) -> int:
    """'5min' / '3h' / '14D' / '30s' -> microseconds."""
    m = re.fullmatch(r"\s*(\d+)\s*(s|min|h|d)\s*", text, flags=re.IGNORECASE)
    if not m:
        raise ValueError(f"Cannot parse duration: {text!r}")
    return int(m.group(1)) * US[m.group(2).lower()]


@dataclass(frozen=True)
class Segment:
    start_us: int          # offset of the first edge from trajectory start
    freq_us: int
    first_counter: int     # 1-based bin_counter of the first bin
    n_bins: int | None     # None: open (runs to the window end)
    label: str             # bin_freq value as configured


def grid_segments(bin_intervals: dict[str, str]) -> list[Segment]:
    """Segments of the relative grid (driver-side, size of the config)."""
    segs: list[Segment] = []
    cur, counter, prev_f = 0, 1, 0
    items = list(bin_intervals.items())
    for i, (end, freq) in enumerate(items):
        f = parse_duration_us(freq)
        if f < prev_f:
            raise ValueError("bin sizes must be non-decreasing along the grid")
        prev_f = f
        if end == "end":
            if i != len(items) - 1:
                raise ValueError("'end' must be the last interval")
            segs.append(Segment(cur, f, counter, None, freq))
            break
        e = parse_duration_us(end)
        if e <= cur:
            segs.append(Segment(cur, f, counter, 0, freq))
            continue
        n_edges = -(-(e - cur) // f)  # edges cur + k f strictly below e
        n = n_edges - 1
        segs.append(Segment(cur, f, counter, n, freq))
        cur += n * f
        counter += n
    return segs


def _lit(v: int) -> str:
    return f"CAST({v} AS BIGINT)"


class Grid:
    """Column builders for one grid configuration.

    Non-decreasing bin sizes (every shipped config): constant segments, all
    bin arithmetic is literal.  Otherwise (``general``) the segments depend
    on each trajectory's end: their edges are one column per interval
    (:meth:`with_segments`); bins are still generated and looked up without
    a join.
    """

    def __init__(self, bin_intervals: dict[str, str]):
        self.bin_intervals = dict(bin_intervals)
        try:
            self.segments = [s for s in grid_segments(bin_intervals) if s.n_bins != 0]
            self.general = False
        except ValueError as e:
            if "non-decreasing" not in str(e):
                raise
            self.segments = []
            self.general = True
        items = list(self.bin_intervals.items())
        for i, (end, _) in enumerate(items):
            if end == "end" and i != len(items) - 1:
                raise ValueError("'end' must be the last interval")

    # -- general (per-row) segments -----------------------------------------
    def with_segments(self, df: DataFrame, window: str) -> DataFrame:
        """Per interval ``i`` the edge at which it begins in a window of length
        ``window`` (us) and the counter of its first bin, ``__c{i}`` and ``__k{i}``,
        and one more pair for where the last one ends; null where the window is
        null or not positive.

        Each interval's edges run from the previous interval's last edge, strictly
        below min(interval end, window end): the number of its bins is one division."""
        df = df.withColumns({"__w": F.expr(window), "__c0": F.expr(f"CASE WHEN ({window}) > 0 THEN {_lit(0)} END"), "__k0": F.lit(1).cast("bigint")})
        for i, (end, freq) in enumerate(self.bin_intervals.items()):
            lim, f = "__w" if end == "end" else f"least({_lit(parse_duration_us(end))}, __w)", _lit(parse_duration_us(freq))
            df = df.withColumn("__n", F.expr(f"greatest({lim} - __c{i} - 1, {_lit(0)}) div {f}"))
            df = df.withColumns({f"__c{i + 1}": F.expr(f"__c{i} + __n * {f}"), f"__k{i + 1}": F.expr(f"__k{i} + __n")})
        return df.drop("__w", "__n")

    def g_columns(self) -> list[str]:
        return [f"__{x}{i}" for i in range(len(self.bin_intervals) + 1) for x in "ck"]

    def _by_segment(self, hit, pick) -> str:
        """``pick(number, bin size, label)`` of the interval for which ``hit(number)`` holds."""
        whens = " ".join(f"WHEN {hit(i)} THEN {pick(i, _lit(parse_duration_us(freq)), freq)}" for i, freq in enumerate(self.bin_intervals.values()))
        return f"(CASE {whens} END)"

    def g_total(self) -> str:
        return f"__k{len(self.bin_intervals)} - 1"

    def g_end(self) -> str:
        """Offset of the last bin's end."""
        return f"__c{len(self.bin_intervals)}"

    def g_of_counter(self, c: str, pick) -> str:
        return self._by_segment(lambda i: f"({c}) < __k{i + 1}", pick)

    def g_of_offset(self, t: str, pick) -> str:
        return self._by_segment(lambda i: f"({t}) >= __c{i} AND ({t}) < __c{i + 1}", pick)

    # -- counts ---------------------------------------------------------
    def n_bins_sql(self, w: str) -> str:
        """Number of bins whose end offset is < ``w`` (window length, us)."""
        parts = []
        for s in self.segments:
            k = f"(({w}) - {_lit(s.start_us)} - 1) div {_lit(s.freq_us)}"
            k = f"greatest({k}, CAST(0 AS BIGINT))"
            if s.n_bins is not None:
                k = f"least({k}, {_lit(s.n_bins)})"
            parts.append(k)
        return " + ".join(parts) if parts else "CAST(0 AS BIGINT)"

    def _case(self, key: str, by_counter: bool, pick) -> str:
        whens = []
        for s in self.segments[:-1]:
            bound = (s.first_counter + s.n_bins) if by_counter else (s.start_us + s.n_bins * s.freq_us)
            whens.append(f"WHEN {key} < {_lit(bound)} THEN {pick(s)}")
        last = pick(self.segments[-1])
        return f"(CASE {' '.join(whens)} ELSE {last} END)" if whens else f"({last})"

    def counter_of_offset_sql(self, t: str) -> str:
        """Half-open bin counter containing offset ``t`` (us, t >= 0); general: null outside every bin."""
        if self.general:
            return self.g_of_offset(t, lambda i, f, _: f"__k{i} + (({t}) - __c{i}) div {f}")
        expr = self._case(t, False, lambda s: f"{_lit(s.first_counter)} + (({t}) - {_lit(s.start_us)}) div {_lit(s.freq_us)}")
        return f"(CASE WHEN ({t}) >= 0 THEN {expr} END)"

    def start_of_counter_sql(self, c: str) -> str:
        if self.general:
            return self.g_of_counter(c, lambda i, f, _: f"__c{i} + (({c}) - __k{i}) * {f}")
        return self._case(c, True, lambda s: f"{_lit(s.start_us)} + (({c}) - {_lit(s.first_counter)}) * {_lit(s.freq_us)}")

    def freq_of_counter_sql(self, c: str) -> str:
        if self.general:
            return self.g_of_counter(c, lambda i, f, _: f)
        return self._case(c, True, lambda s: _lit(s.freq_us))

    def label_of_counter_sql(self, c: str) -> str:
        if self.general:
            return self.g_of_counter(c, lambda i, _, label: f"'{label}'")
        return self._case(c, True, lambda s: "'" + s.label + "'")

    # -- column helpers -------------------------------------------------
    @staticmethod
    def window_us(start: str = "start", end: str = "end") -> str:
        return f"{micros_sql(start, end)} + {_lit(WINDOW_SLACK_US)}"


def _bin_cols(grid: Grid, start: str, counter: str = "bin_counter") -> list[Column]:
    s_off = grid.start_of_counter_sql(counter)
    f = grid.freq_of_counter_sql(counter)
    return [
        F.expr(f"timestampadd(MICROSECOND, {s_off}, {start})").alias("bin_start"),
        F.expr(f"timestampadd(MICROSECOND, {s_off} + {f}, {start})").alias("bin_end"),
        F.col(counter).cast("int").alias("bin_counter"),
        F.expr(grid.label_of_counter_sql(counter)).alias("bin_freq"),
    ]


def with_bin_total(base: DataFrame, grid: Grid, start: str = "start", end: str = "end",
                   drop_last_col: str | None = None, out: str = "__nbins") -> DataFrame:
    """Number of bins per trajectory; 0 for null or empty windows.

    ``drop_last_col`` (boolean) removes the last bin when more than one
    exists (W8, mortality masking) -- no window needed, the count is known.
    """
    w = grid.window_us(start, end)
    if grid.general:
        base = grid.with_segments(base, w)
        total = f"coalesce({grid.g_total()}, CAST(0 AS BIGINT))"
    else:
        base = base.withColumn("__w", F.expr(w))
        total = f"CASE WHEN {start} IS NULL OR {end} IS NULL OR __w <= 0 THEN CAST(0 AS BIGINT) ELSE {grid.n_bins_sql('__w')} END"
    df = base.withColumn(out, F.expr(total)).drop("__w")
    if drop_last_col:
        df = df.withColumn(out, F.when(F.coalesce(F.col(drop_last_col), F.lit(False)) & (F.col(out) > 1),
                                       F.col(out) - 1).otherwise(F.col(out)))
    return df


def make_bins(base: DataFrame, bin_intervals: dict[str, str], id_col: str = "PID",
              start: str = "start", end: str = "end", drop_last_col: str | None = None) -> DataFrame:
    """Bin grid ``(PID, bin_start, bin_end, bin_counter, bin_freq)``.

    One narrow ``explode`` per trajectory; rows skipped when start/end is
    null or ``end + 10 min <= start``.
    """
    grid = Grid(bin_intervals)
    df = with_bin_total(base.select(id_col, start, end, *([drop_last_col] if drop_last_col else [])),
                        grid, start, end, drop_last_col)
    # no row from null: a filter would be pushed down and count the bins a second time
    df = df.withColumn("bin_counter", F.explode(F.when(F.col("__nbins") >= 1, F.sequence(F.lit(1).cast("bigint"), F.col("__nbins")))))
    return df.select(F.col(id_col), *_bin_cols(grid, start))


def assign_points(events: DataFrame, base: DataFrame, bin_intervals: dict[str, str],
                  id_col: str = "PID", ts_col: str = "TIMESTAMP", start: str = "start",
                  end: str = "end", closed: bool = False,
                  drop_last_col: str | None = None) -> DataFrame:
    """Attach the bin of each point event (J8 half-open, J9 ``closed=True``).

    ``events`` needs ``id_col`` and ``ts_col``; ``base`` one row per id with
    ``start``/``end``.  Events outside every emitted bin are dropped; with
    ``closed`` an event on an edge lands in both adjacent bins.
    """
    grid = Grid(bin_intervals)
    keep = [id_col, start, "__nbins", *(grid.g_columns() if grid.general else [])]
    own = [start, end, *([drop_last_col] if drop_last_col else [])]
    carried = set(own) <= set(events.columns)
    if carried:
        # events that carry their window (it was joined to them before) need no second join on a hot id
        ev = with_bin_total(events, grid, start, end, drop_last_col).drop(*own[1:])
    else:
        b = with_bin_total(base.select(id_col, *own), grid, start, end, drop_last_col).select(*keep)
        ev = events.join(b, on=id_col, how="inner")
    ev = ev.withColumn("__t", F.expr(micros_sql(start, ts_col)))
    c_here = grid.counter_of_offset_sql("__t")
    if closed:
        c_prev = grid.counter_of_offset_sql("(__t - 1)")
        prev_end = f"{grid.start_of_counter_sql(c_prev)} + {grid.freq_of_counter_sql(c_prev)}"
        if grid.general:
            ev, c_prev = ev.withColumn("__prev", F.expr(c_prev)), "__prev"
            prev_end = f"{grid.start_of_counter_sql(c_prev)} + {grid.freq_of_counter_sql(c_prev)}"
        cands = f"array_distinct(filter(array({c_here}, CASE WHEN {prev_end} = __t THEN {c_prev} END), x -> x IS NOT NULL))"
        ev = ev.withColumn("bin_counter", F.explode(F.expr(cands)))
    else:
        ev = ev.withColumn("bin_counter", F.expr(c_here))
    has = (F.col("bin_counter") >= 1) & (F.col("bin_counter") <= F.col("__nbins"))
    # a filter would be pushed down, below the join that gave the event its window, and work out offset, edges and bin once more for each mention
    ev = worked_out_once(ev, "bin_counter", "__nbins").where(has)
    rest = [c for c in events.columns if c != id_col and not (carried and c in own)]
    return ev.select(id_col, *rest, *_bin_cols(grid, start))


def attach_to_grid(base: DataFrame, found: DataFrame, bin_intervals: dict[str, str], id_col: str = "PID", start: str = "start",
                   end: str = "end", drop_last_col: str | None = None) -> DataFrame:
    """A10 without a table of bins: every bin of every trajectory once, with the
    rows that ``found`` (id, ``bin_counter``, FEATURE, more) has for it or nulls.

    The rows found for a trajectory are put in order of their bins; each takes
    the empty bins up to the next one along (the first one those before it too).
    So they meet the trajectory by its id, and the bins, many times as many, are
    exploded after the join: none is shuffled.  (Both sides are dealt to a fixed
    number of tasks, as a size that suits the rows joined is far too large for
    the bins that come of them.)  Equal to
    ``make_bins(...).join(found, [id_col, "bin_counter"], "left")``."""
    grid = Grid(bin_intervals)
    b = with_bin_total(base.select(id_col, start, end, *([drop_last_col] if drop_last_col else [])), grid, start, end, drop_last_col)
    b = b.drop(*[c for c in (end, drop_last_col) if c])
    rest = [c for c in found.columns if c not in (id_col, "bin_counter")]
    w = Window.partitionBy(id_col).orderBy("__at")
    n = shuffle_partitions(base.sparkSession)
    # a bin that the trajectory does not have (none is placed there) must not take others along
    rows = found.where(F.col(id_col).isNotNull() & (F.col("bin_counter") >= 1)).select(
        id_col, F.col("bin_counter").cast("bigint").alias("__at"), F.struct(*rest).alias("__found")).repartition(n, id_col)
    rows = rows.withColumn("__first", F.lag("__at").over(w).isNull()).withColumn("__next", F.lead("__at").over(w))
    out = b.repartition(n, id_col).join(rows, id_col, "left")
    lo = F.when(F.coalesce(F.col("__first"), F.lit(True)), F.lit(1).cast("bigint")).otherwise(F.col("__at"))
    hi = F.when(F.col("__next").isNull(), F.col("__nbins")).otherwise(F.least(F.greatest(F.col("__next") - 1, F.col("__at")), F.col("__nbins")))
    out = out.withColumn("__lo", lo).withColumn("__hi", hi).where(F.col("__lo") <= F.col("__hi")) \
             .withColumn("bin_counter", F.explode(F.sequence(F.col("__lo"), F.col("__hi"))))
    here = F.col("bin_counter") == F.col("__at")
    return out.select(id_col, *_bin_cols(grid, start), *[F.when(here, F.col(f"__found.{c}")).alias(c) for c in rest])


def expand_intervals(events: DataFrame, base: DataFrame, bin_intervals: dict[str, str],
                     id_col: str = "PID", ts_col: str = "TIMESTAMP", end_ts_col: str = "END_TIMESTAMP",
                     start: str = "start", end: str = "end") -> DataFrame:
    """Interval events to one row per overlapping bin.

    Overlap is strict: ``ev.start < bin_end AND ev.end > bin_start``.  The
    output keeps the event columns without ``END_TIMESTAMP`` and sets
    ``TIMESTAMP := bin_start``.  Rows per event = bins it spans (bounded by
    the grid), produced by ``explode(sequence(lo, hi))`` -- no join with bins.
    """
    grid = Grid(bin_intervals)
    keep = [id_col, start, "__nbins", *(grid.g_columns() if grid.general else [])]
    b = with_bin_total(base.select(id_col, start, end), grid, start, end).select(*keep)
    ev = events.join(b, on=id_col, how="inner")
    ts_off = micros_sql(start, ts_col)
    te_off = micros_sql(start, end_ts_col)
    if grid.general:
        lo = (f"CASE WHEN {ts_off} < 0 THEN CAST(1 AS BIGINT) WHEN {ts_off} >= coalesce({grid.g_end()}, CAST(0 AS BIGINT)) "
              f"THEN __nbins + 1 ELSE {grid.counter_of_offset_sql(ts_off)} END")
        hi_c = f"least(__nbins, coalesce({grid.counter_of_offset_sql(f'({te_off} - 1)')}, __nbins))"
        hi = f"CASE WHEN {te_off} >= 1 THEN {hi_c} END"
    else:
        lo = f"CASE WHEN {ts_off} < 0 THEN CAST(1 AS BIGINT) ELSE {grid.counter_of_offset_sql(ts_off)} END"
        hi = (f"CASE WHEN {te_off} >= 1 THEN "
              f"least(__nbins, {grid.counter_of_offset_sql(f'({te_off} - 1)')}) END")
    ev = ev.withColumn("__lo", F.expr(lo)).withColumn("__hi", F.expr(hi))
    ev = ev.where(F.col("__lo") <= F.col("__hi"))
    ev = ev.withColumn("bin_counter", F.explode(F.sequence(F.col("__lo"), F.col("__hi"))))
    s_off = grid.start_of_counter_sql("bin_counter")
    ev = ev.withColumn(ts_col, F.expr(f"timestampadd(MICROSECOND, {s_off}, {start})"))
    keep = [c for c in events.columns if c != end_ts_col]
    return ev.select(*keep)


def check_bin_freqs(bins: DataFrame, bin_intervals: dict[str, str], strict: bool = False) -> list[str]:
    """Freshness check of a stored grid.

    Unknown frequencies always raise; frequencies never reached by any
    trajectory are returned (and raise only with ``strict=True``).
    """
    present = {r[0] for r in bins.select("bin_freq").distinct().collect()}
    configured = set(bin_intervals.values())
    unknown = present - configured
    if unknown:
        raise ValueError(f"bin grid has frequencies not in config: {sorted(unknown)}")
    missing = sorted(configured - present)
    if strict and missing:
        raise ValueError(f"bin grid is missing frequencies: {missing}")
    return missing
