"""Scalar column expressions (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters the reference's string strip removes in practice
# (space, tab, newline, carriage return, form feed, vertical tab).
WHITESPACE = " \t\n\r\f\u000b"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_string(col: Column | str) -> Column:
    """Strip surrounding whitespace; null stays null (plain ``trim`` strips spaces only)."""
    return F.btrim(_c(col).cast("string"), F.lit(WHITESPACE))


def canonical_id(col: Column | str) -> Column:
    """Canonical entity id text.

    Digits with a zero fraction lose the fraction (``'31000.0'``, ``' 31000 '``
    and ``'\\t31000'`` all become ``'31000'``); any other text is kept trimmed,
    also texts that a number parser would take (``'31000D'``, ``'1E003'``,
    ``'007'``). Null stays null.
    """
    return F.regexp_replace(clean_string(col), r"^([0-9]+)\.0+$", "$1")


def tolerant_double(col: Column | str) -> Column:
    """Number parse where bad text becomes null."""
    return clean_string(col).try_cast("double")


def tolerant_timestamp(col: Column | str) -> Column:
    """Timestamp parse where bad or empty text becomes null."""
    c = _c(col)
    # naive (zone-less) result, like the source text
    return F.try_to_timestamp(clean_string(c.cast("string"))).cast("timestamp_ntz")


def to_day(col: Column | str) -> Column:
    """Timestamp (or timestamp text) to calendar date; bad text gives null."""
    return F.to_date(tolerant_timestamp(col))


def minutes_of_day(col: Column | str) -> Column:
    """Time text such as ``'2020-01-01 18:05:00'`` or ``'06:30:00'`` to minutes after midnight."""
    c = clean_string(col)
    ts = F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), c)))
    return F.hour(ts) * 60 + F.minute(ts)


def weekday_monday0(col: Column | str) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(col))


def calendar_columns(date_col: str = "date") -> dict[str, Column]:
    """year, month, day, weekday (Monday 0) and weekend flag of a date column."""
    d = F.col(date_col)
    wd = F.weekday(d)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "weekday": wd,
        "is_weekend": wd.isin(5, 6).cast("int"),
    }


def underscore(col: Column | str) -> Column:
    """Literal replace of every space by ``_``."""
    return F.replace(_c(col), F.lit(" "), F.lit("_"))


def count_column_name(*parts: str) -> str:
    """Pivot column name rule: parts with spaces as ``_`` joined by ``_`` plus ``_count``."""
    return "_".join(p.replace(" ", "_") for p in parts) + "_count"


def param_text(col: Column | str) -> Column:
    """Parameter value as label text, null shown as ``None``."""
    return F.coalesce(_c(col).cast("string"), F.lit("None"))
