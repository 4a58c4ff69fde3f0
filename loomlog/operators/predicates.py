"""Filters over a union view, compiled to one Column.

Every string predicate works on the text form of its field, ignores case, and
has a stated result for null: only ``is_not_one_of`` and ``does_not_exist``
let null rows in.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.fields import SOURCE, as_text, named, resolve, text_field
from loomlog.functions.times import text_to_timestamp

UNARY = ("exists", "does_not_exist")


@dataclass(frozen=True)
class Filter:
    """``logic`` joins it to what stands before; AND binds tighter than OR."""

    field: str
    op: str
    value: str = ""
    logic: str = "and"


def _like(text: Column, pattern: str, literal: bool = False) -> Column:
    """Case-blind LIKE; % and _ are wildcards unless ``literal``, the backslash never is special."""
    pattern = pattern.replace("\\", "\\\\")
    return text.ilike(pattern.replace("%", "\\%").replace("_", "\\_") if literal else pattern)


def _contains(text: Column, value: str, literal: bool) -> Column:
    if literal:
        return F.contains(F.lower(text), F.lit(value.lower()))
    return _like(text, f"%{value}%")


def _one_of(value: str) -> list[str]:
    return [v.strip().lower() for v in value.split(",") if v.strip()]


def condition(text: Column, op: str, value: str = "", literal: bool = False) -> Column | None:
    """One filter on a text column; None where it is incomplete or unknown and so doesn't count."""
    if op not in UNARY and value == "":
        return None
    folded = F.lower(text)
    if op == "exists":
        return text.isNotNull() & (text != "")
    if op == "does_not_exist":
        return text.isNull() | (text == "")
    if op == "is":
        return folded == value.lower()
    if op == "is_not":
        return folded != value.lower()
    if op == "contains":
        return _contains(text, value, literal)
    if op == "not_contains":
        return ~_contains(text, value, literal)
    if op == "wildcard":
        return _like(text, value.replace("*", "%"))
    if op == "not_wildcard":
        return ~_like(text, value.replace("*", "%"))
    if op in ("is_one_of", "is_not_one_of"):
        values = _one_of(value)
        if not values:
            return None
        return folded.isin(values) if op == "is_one_of" else ~folded.isin(values) | text.isNull()
    return None


def filters(view: DataFrame, items: list[Filter], literal: bool = False) -> Column | None:
    """All complete filters, flat: an OR of ANDs."""
    groups: list[list[Column]] = []
    for f in items:
        made = condition(text_field(view, f.field), f.op, f.value, literal) if f.field else None
        if made is None:
            continue
        if groups and f.logic.lower() != "or":
            groups[-1].append(made)
        else:
            groups.append([made])
    return reduce(or_, (reduce(and_, g) for g in groups)) if groups else None


def time_range(view: DataFrame, field: str, start: str | None = None, end: str | None = None) -> Column | None:
    """``start <= field <= end``, rows without a readable timestamp out; native types reach the scan."""
    column = resolve(view, field)
    kind = view.select(column.alias("x")).schema[0].dataType
    if isinstance(kind, T.TimestampNTZType):
        bound = lambda x: F.lit(x).try_cast("timestamp").cast("timestamp_ntz")
    elif isinstance(kind, (T.TimestampType, T.DateType)):
        bound = lambda x: F.lit(x).try_cast("timestamp")
    else:
        column = text_to_timestamp(as_text(column, kind))
        bound = lambda x: text_to_timestamp(F.lit(x))
    terms = [column >= bound(start)] * (start is not None) + [column <= bound(end)] * (end is not None)
    return reduce(and_, terms) if terms else None


def search(view: DataFrame, text: str, literal: bool = False) -> Column | None:
    """Rows with ``text`` in any top-level column."""
    if not text:
        return None
    columns = [as_text(named(f.name), f.dataType) for f in view.schema if f.name != SOURCE]
    return reduce(or_, (_contains(c, text, literal) for c in columns))


def predicate(view: DataFrame, items: list[Filter] = (), ts_field: str | None = None, start: str | None = None, end: str | None = None, text: str = "", strict: bool = True, literal: bool = False) -> Column:
    """Time range, filters and search together.

    ``strict``: all three must hold.  Otherwise they are chained flat, as if
    written in one line: an OR among the filters lets go of the time range before
    it and of the search after it.
    """
    within = time_range(view, ts_field, start, end) if ts_field else None
    found = search(view, text, literal)
    if strict:
        terms = [t for t in (within, filters(view, list(items), literal), found) if t is not None]
        return reduce(and_, terms) if terms else F.lit(True)
    groups: list[list[Column]] = [[within]] if within is not None else []
    for f in items:
        made = condition(text_field(view, f.field), f.op, f.value, literal) if f.field else None
        if made is None:
            continue
        if groups and f.logic.lower() != "or":
            groups[-1].append(made)
        else:
            groups.append([made])
    if found is not None:
        groups[-1].append(found) if groups else groups.append([found])
    return reduce(or_, (reduce(and_, g) for g in groups)) if groups else F.lit(True)


def preset(name: str, now: datetime) -> tuple[str, str]:
    """Start and end of a relative range: 15m, 1h, 4h, 24h, 7d, today; ``now`` is naive UTC."""
    if name == "today":
        day = now.replace(hour=0, minute=0, second=0, microsecond=0)
        return day.isoformat(" "), (day + timedelta(days=1) - timedelta(milliseconds=1)).isoformat(" ")
    span = {"15m": timedelta(minutes=15), "1h": timedelta(hours=1), "4h": timedelta(hours=4), "24h": timedelta(hours=24), "7d": timedelta(days=7)}[name]
    return (now - span).isoformat(" "), now.isoformat(" ")
