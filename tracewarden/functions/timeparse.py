"""Times as epoch seconds: columns in and out, and literals that people type."""

from __future__ import annotations

import calendar
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewarden.schema import DEFAULTS, EARLIEST, LATEST

LAST_YEAR = 2100  # of a time that people type, as the engine that is matched has it


def epoch_text(seconds: Column) -> Column:
    """UTC text 'YYYY-MM-DD HH:MM:SS', whatever the session's time zone."""
    utc = F.timestamp_seconds(seconds)
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), utc.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")


def local_hour(seconds: Column, offset: int = DEFAULTS.utc_offset) -> Column:
    """Hour of the day at a fixed offset; null where adding the offset overflows."""
    return (F.try_add(seconds, F.lit(offset).cast("long")) % 86_400 / 3600).cast("long")


TEXT = re.compile(r"\s*([+-]?\d+)-(\d+)-(\d+)(?:\s+(\d+)(?::(\d+)(?::(\d+))?)?)?")


def parse_time(text: str) -> int | None:
    """Epoch seconds of 'Y-M-D[ h[:m[:s]]]' in UTC; what follows is ignored; a day past the month's end runs into the next."""
    m = TEXT.match(text)
    if not m:
        return None
    y, mo, d, h, mi, s = (int(g) if g else 0 for g in m.groups())
    if not (1970 <= y <= LAST_YEAR and 1 <= mo <= 12 and 1 <= d <= 31 and h <= 23 and mi <= 59 and s <= 59):
        return None
    return calendar.timegm((y, mo, 1, 0, 0, 0)) + (d - 1) * 86_400 + h * 3600 + mi * 60 + s


def text_epoch(text: Column, last_year: int = LAST_YEAR) -> Column:
    """parse_time of a column; times of a log that runs further need a later `last_year` (9999 at most)."""

    def part(k: int) -> Column:
        got = F.regexp_extract(text, r"^\s*([+-]?\d+)-(\d+)-(\d+)(?:\s+(\d+)(?::(\d+)(?::(\d+))?)?)?", k)
        return F.coalesce(F.when(got == "", None).otherwise(got).try_cast("long"), F.lit(0))

    year, month, day, hour, minute, second = (part(k) for k in range(1, 7))
    fine = year.between(1970, last_year) & month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 59)
    first = F.when(fine, F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))
    return (F.datediff(first, F.lit("1970-01-01").cast("date")).cast("long") + day - 1) * 86_400 + hour * 3600 + minute * 60 + second


def literal_epoch(text: Column, default: int, last_year: int = LAST_YEAR) -> Column:
    """time_literal of a column."""
    bare = F.btrim(text)
    return F.when(bare == "", F.lit(default).cast("long")).when(bare.rlike(r"^-?\d+$"), bare.try_cast("long")).otherwise(text_epoch(bare, last_year))


def time_literal(text: str, default: int) -> int | None:
    """Empty text: the default; digits with an optional minus: epoch seconds; else parse_time."""
    text = text.strip()
    if not text:
        return default
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return parse_time(text)


def time_range(start: str = "", end: str = "") -> tuple[int, int]:
    """Both ends, in order; ValueError if one can't be read."""
    a, b = time_literal(start, EARLIEST), time_literal(end, LATEST)
    if a is None or b is None:
        raise ValueError(f"not a time: {start if a is None else end!r}")
    return min(a, b), max(a, b)
