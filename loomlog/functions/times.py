"""Timestamps from text, by layouts written as an example date, and fixed-width time buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pieces of an example date (2 January 2006, 15:04:05) and their patterns, longest first.
LAYOUT_PIECES = (
    ("Z07:00", "XXX"), ("-07:00", "xxx"), ("Z0700", "XX"), ("-0700", "xx"), ("January", "MMMM"), ("Monday", "EEEE"),
    ("2006", "yyyy"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"), ("PM", "a"),
    ("01", "MM"), ("02", "dd"), ("_2", "d"), ("03", "hh"), ("15", "HH"), ("04", "mm"), ("05", "ss"), ("06", "yy"),
)
#: Fractions are read whether or not a layout has one, with up to nine digits.
FRACTION = re.compile(r"[.,](?:0+|9+)(?!\d)")
MAYBE_FRACTION = "".join(f"[.{'S' * n}]" for n in range(9, 0, -1))

# Widths of time buckets in seconds.
WIDTHS = (
    1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200,
    86400, 172800, 604800, 2592000, 7776000, 31536000,
)
MAX_BUCKETS = 120
#: Buckets are counted from this Monday.
ORIGIN = "2000-01-03 00:00:00"


def spark_pattern(layout: str) -> str:
    """A layout as a Spark datetime pattern; the fraction of a second is always optional."""
    layout = FRACTION.sub("", layout)
    out, i = "", 0
    while i < len(layout):
        for piece, pattern in LAYOUT_PIECES:
            if layout.startswith(piece, i):
                out += pattern + (MAYBE_FRACTION if piece == "05" else "")
                i += len(piece)
                break
        else:
            c = layout[i]
            out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
            i += 1
    return out


def has_zone(layout: str) -> bool:
    return any(z in layout for z in ("Z07:00", "Z0700", "-0700", "-07:00", "MST"))


def parse_layout(text: Column, layout: str, zone: str = "UTC") -> Column:
    """A timestamp read by ``layout``, naive ones as local time in ``zone``; null where it doesn't fit.

    Runs of blanks count as one, a comma may stand before the fraction.
    The session's time zone must be UTC.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"(\d{2}:\d{2}:\d{2}),(\d)", "$1.$2"), " +", " ")
    parsed = F.try_to_timestamp(plain, F.lit(spark_pattern(layout)))
    return parsed if has_zone(layout) or zone == "UTC" else F.to_utc_timestamp(parsed, zone)


def text_to_timestamp(text: Column) -> Column:
    """Text that begins like a date as a naive UTC timestamp, null otherwise.

    A plain cast would take a bare year or a time of day, too.
    """
    return F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp")).cast("timestamp_ntz")


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC with as many fraction digits as needed."""
    return F.concat(F.replace(ts.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def present(ts: Column, zone: str = "UTC", hours: int = 24) -> Column:
    """A UTC timestamp as a reader in ``zone`` sees it: date, time with milliseconds, on a clock of 24 or 12 hours."""
    if hours not in (12, 24):
        raise ValueError("clocks have 12 or 24 hours")
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "yyyy-MM-dd HH:mm:ss.SSS" if hours == 24 else "yyyy-MM-dd hh:mm:ss.SSS a")


def pick_width(seconds: int) -> int:
    """The least width of at most MAX_BUCKETS whole buckets in a span; whole days beyond the table."""
    for width in WIDTHS:
        if seconds // width <= MAX_BUCKETS:
            return width
    return (seconds // MAX_BUCKETS // 86400 + 1) * 86400


def bucket(ts: Column, width: int) -> Column:
    """The beginning of the bucket of ``width`` seconds that a naive timestamp is in."""
    origin = F.lit(ORIGIN).cast("timestamp_ntz")
    return since_origin(F.floor(F.timestamp_diff("MICROSECOND", origin, ts) / F.lit(1_000_000 * width)) * width)


def since_origin(seconds: Column) -> Column:
    """The naive timestamp so many whole seconds after ORIGIN; days and seconds apart, as either must fit an int."""
    day = F.timestamp_add("DAY", F.floor(seconds / 86400).cast("int"), F.lit(ORIGIN).cast("timestamp_ntz"))
    return F.timestamp_add("SECOND", F.pmod(seconds, F.lit(86400)).cast("int"), day)
