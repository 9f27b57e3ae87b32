"""Projections, predicates and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefns import micros_between


def to_long_model(df: DataFrame, mapping: dict[str, str], extra: Sequence[str] = ()) -> DataFrame:
    """Rename raw columns into the long model and keep only those."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()], *extra)


def prefix_filter(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Code starts with ``prefix`` (pushed to the scan as StringStartsWith)."""
    return df.where(F.col(col).startswith(prefix))


def member_filter(df: DataFrame, col: str, values: Sequence[str] | DataFrame, keep: bool = True) -> DataFrame:
    """Membership (``keep``) or exclusion.  A literal list becomes an
    ``IN`` set; a DataFrame of values is a semi/anti join.  Exclusion keeps
    null values (``~isin`` alone would drop them)."""
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(v, on=col, how="left_semi" if keep else "left_anti")
    cond = F.col(col).isin(list(values))
    if keep:
        return df.where(cond)
    return df.where(F.col(col).isNull() | ~cond)


def active_at_index(noted: Column, resolved: Column, start: Column, days: int = 1) -> Column:
    """Noted at least ``days`` before start, and unresolved or resolved
    at least ``days`` after start."""
    d = F.make_interval(days=F.lit(days))
    return (noted <= start - d) & (resolved.isNull() | (resolved >= start + d))


def mask_after(concept: DataFrame, base: DataFrame | None, delta: Column | str,
               id_col: str = "PID", ts_col: str = "TIMESTAMP", start: str = "start") -> DataFrame:
    """Keep ``TIMESTAMP <= start + delta`` (no lower bound).  Without a
    base ``start`` the first TIMESTAMP per PID stands in (one aggregate +
    join, not a window over the whole patient)."""
    d = parse_masking_point(delta) if isinstance(delta, str) else delta
    if base is None or start not in base.columns:
        starts = concept.groupBy(id_col).agg(F.min(ts_col).alias("__start"))
    else:
        starts = base.select(id_col, F.col(start).alias("__start"))
    j = concept.join(starts, on=id_col, how="left")
    return j.where(F.col(ts_col) <= F.col("__start") + d).select(*concept.columns)


# Seconds per unit of a duration text (fixed values).
DURATION_UNITS = {"w": 604800, "week": 604800, "weeks": 604800, "d": 86400, "day": 86400, "days": 86400,
                  "h": 3600, "hr": 3600, "hour": 3600, "hours": 3600, "m": 60, "min": 60, "minute": 60, "minutes": 60,
                  "s": 1, "sec": 1, "second": 1, "seconds": 1, "ms": 1e-3, "us": 1e-6}


def duration_seconds(text: str) -> float:
    """A duration text in seconds: numbers with units ('24h', '1 day 30 min',
    '2D'), a clock ('02:00:00', '26:30:00.5'), days and a clock
    ('1 days 02:00:00'), each with an optional sign."""
    import re
    t = text.strip().lower()
    sign = -1 if t.startswith("-") else 1
    rest = t.lstrip("+-").strip() if t[:1] in ("+", "-") else t
    clock = re.search(r"(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)$", rest)
    total, parts = 0.0, 0
    if clock:
        hours, minutes, seconds = clock.groups()
        total, parts = int(hours) * 3600 + int(minutes) * 60 + float(seconds), 1
        rest = rest[:clock.start()].strip().removesuffix("+").strip()
    while rest:
        m = re.match(r"(\d+(?:\.\d+)?)\s*([a-z]+)[\s,]*", rest)
        if not m or m.group(2) not in DURATION_UNITS:
            raise ValueError(f"Cannot parse masking point {text!r}")
        total, parts, rest = total + float(m.group(1)) * DURATION_UNITS[m.group(2)], parts + 1, rest[m.end():]
    if not parts:
        raise ValueError(f"Cannot parse masking point {text!r}")
    return sign * total


def parse_masking_point(value) -> Column | None:
    """P10: None -> no mask; a ``datetime.timedelta`` or a duration text
    (:func:`duration_seconds`) -> an interval literal; else an error."""
    import datetime as _dt
    if value is None:
        return None
    if isinstance(value, _dt.timedelta):
        return F.make_dt_interval(secs=F.lit(value.total_seconds()))
    if isinstance(value, str):
        return F.make_dt_interval(secs=F.lit(duration_seconds(value)))
    raise TypeError(f"Unsupported masking point type: {type(value).__name__}")


def keyword_flags(df: DataFrame, text: str, keywords: Sequence[str], new_column: str = "keyword",
                  timestamp: str | None = None, base_timestamp: str | None = None,
                  hours: float = 12) -> DataFrame:
    """Case-insensitive keyword hit in the whole text (null -> False),
    and a ``{new_column}_within`` flag when the hit is at most ``hours``
    after the base time (upper bound only)."""
    import re
    pat = "(?iU)(?:" + "|".join(re.escape(k) for k in keywords) + ")"
    out = df.withColumn(new_column, F.coalesce(F.col(text).rlike(pat), F.lit(False)))
    if timestamp and base_timestamp:
        lim = F.lit(int(hours * 3_600_000_000))
        out = out.withColumn(f"{new_column}_within",
                             F.col(new_column) & F.coalesce(micros_between(F.col(base_timestamp), F.col(timestamp)) <= lim,
                                                            F.lit(False)))
    return out


def align_frames(a: DataFrame, b: DataFrame, fill_value: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Same column set in both frames (missing filled), non-digit names
    sorted first, digit names after in numeric order."""
    cols = set(a.columns) | set(b.columns)
    order = sorted(c for c in cols if not c.isdigit()) + sorted((c for c in cols if c.isdigit()), key=int)

    def fill(df):
        return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(fill_value).alias(c) for c in order])
    return fill(a), fill(b)


def split_xy(df: DataFrame, target: str, id_col: str = "PID", include_id: bool = False):
    """Feature frame and label frame (id kept on both when asked)."""
    feats = [c for c in df.columns if c not in (target, id_col)]
    x = df.select(*([id_col] if include_id else []), *feats)
    y = df.select(*([id_col] if include_id else []), target)
    return x, y


def fill_window_from_date(df: DataFrame, date_col: str = "ServiceDate") -> DataFrame:
    """Missing start/end <- the index date."""
    return df.withColumn("start", F.coalesce("start", date_col)).withColumn("end", F.coalesce("end", date_col))


def preop_cutoff(df: DataFrame) -> Column:
    """knife_time -> ServiceDatetime_1 -> ServiceDate (tolerates a
    missing ServiceDatetime_1)."""
    chain = [F.col("knife_time")]
    if "ServiceDatetime_1" in df.columns:
        chain.append(F.col("ServiceDatetime_1"))
    chain.append(F.col("ServiceDate"))
    return F.coalesce(*chain)


def union_by_name(*dfs: DataFrame, distinct: bool = False) -> DataFrame:
    """Union by name with missing columns as null; optional distinct."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.distinct() if distinct else out


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``left`` absent from ``right`` (anti join on distinct keys)."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), on=list(keys), how="left_anti")
