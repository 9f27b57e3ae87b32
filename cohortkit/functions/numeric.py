"""Numeric text parsing and unit conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit conversion factors.
INCH_CM = 2.54
FOOT_CM = 30.48
POUND_KG = 0.45359237
OUNCE_KG = 0.0283495231

# A plain decimal number (what a strict float parser accepts, minus the
# words nan/inf that try_cast would also take; '5d' is rejected).
NUMBER_RE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
# "looks numeric": both alternatives of the source pattern need a digit.
HAS_DIGIT_RE = r"[0-9]"


def numeric_or_null(c: Column) -> Column:
    """Coerce to double, invalid text -> null (never raises); NaN -> null."""
    s = c.cast("string")
    v = F.when(s.rlike(NUMBER_RE), F.trim(s).try_cast("double"))
    return F.when(~F.isnan(v), v)


def numeric_column(df, name: str) -> Column:
    """Numeric view of a column: native numbers pass through (no string
    round trip), text goes through :func:`numeric_or_null`."""
    from pyspark.sql.types import NumericType
    if isinstance(df.schema[name].dataType, NumericType):
        c = F.col(name).cast("double")
        return F.when(~F.isnan(c), c)
    return numeric_or_null(F.col(name))


def looks_numeric(c: Column) -> Column:
    """P5: value contains a number."""
    return c.cast("string").rlike(HAS_DIGIT_RE)


def parse_numeric(c: Column) -> Column:
    """Strip a leading ``<``/``>`` (and spaces), then parse."""
    return numeric_or_null(F.regexp_replace(F.trim(c), r"^[<>]\s*", ""))


def lab_clean(c: Column) -> Column:
    """``,`` -> ``.``, drop ``*``, drop ``<``/``>`` anywhere."""
    return F.regexp_replace(F.translate(c, ",", "."), r"[*<>]", "")


def inches_to_cm(c: Column) -> Column:
    return c * F.lit(INCH_CM)


def feet_to_cm(c: Column) -> Column:
    return c * F.lit(FOOT_CM)


def pounds_to_kg(c: Column) -> Column:
    return c * F.lit(POUND_KG)


def ounces_to_kg(c: Column) -> Column:
    return c * F.lit(OUNCE_KG)
