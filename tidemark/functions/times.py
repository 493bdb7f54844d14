"""Instants and their text forms, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def ntz_micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp_ntz column that holds UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast(`{name}` as timestamp_ntz))")


def iso_micros(name: str) -> Column:
    """Microseconds since 1970 of ISO text with offset; text that is no time gives null.

    Text without an offset is read as UTC.
    """
    t = F.trim(F.col(name))
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def ntz_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def neutral(c: Column | str) -> Column:
    """Spelling-neutral text: trimmed of white space and lower-cased; blank is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))
