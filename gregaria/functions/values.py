"""Scalar expressions over graph values; all run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def ms_of_timestamp(name: str) -> Column:
    """Epoch milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")


def ms_of_date(day: Column) -> Column:
    """Epoch milliseconds of a date's midnight in UTC."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_MS


def parse_ms(text: Column) -> Column:
    """Epoch milliseconds of ``yyyy-MM-ddTHH:mm:ss.SSS+zone``; null for null and malformed text."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ")))


def parse_list(text: Column) -> Column:
    """Values between semicolons, an empty array for null and empty text; empty values are kept but for a last one."""
    values = F.split(F.regexp_replace(text, ";$", ""), ";")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(values)


def shown_content(content: Column, image: Column) -> Column:
    """The content, or where it is empty or null the picture's name."""
    return F.coalesce(F.nullif(content, F.lit("")), image)


def minutes_between(earlier: Column, later: Column) -> Column:
    """Whole minutes from one time to another, in milliseconds, rounded down."""
    return F.floor((later - earlier) / 60_000).cast("int")


def next_month(month: int) -> int:
    return month % 12 + 1


def born_around(birthday: Column, month: int) -> Column:
    """From the 21st of a month to the 21st of the next."""
    m, d = F.month(birthday), F.dayofmonth(birthday)
    return ((m == month) & (d >= 21)) | ((m == next_month(month)) & (d < 22))


def reply_weight(to_post: Column) -> Column:
    return F.when(to_post, 1.0).otherwise(0.5)
