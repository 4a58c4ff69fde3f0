"""Sorted pages: offset and keyset paging, totals, column order, row clean-up."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.fields import SOURCE, as_text, named, pick_timestamp_field, resolve

DEFAULT_LIMIT = 100
# Columns that stand first, in this order.
FIRST_COLUMNS = ("@timestamp", "level", "log.level", "severity", "message", "msg")


def sort_column(view: DataFrame, field: str | None = None) -> Column:
    """The requested field, or the timestamp field where the view hasn't got it."""
    if field:
        try:
            return resolve(view, field)
        except KeyError:
            pass
    return resolve(view, pick_timestamp_field([c for c in view.columns if c != SOURCE]))


def page(view: DataFrame, field: str | None = None, descending: bool = False, limit: int = DEFAULT_LIMIT, offset: int = 0, ties: list[str] = ()) -> DataFrame:
    """Rows offset .. offset + limit by ``field``, nulls last either way, ``ties`` deciding between equals."""
    column = sort_column(view, field)
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return view.orderBy(order, *[resolve(view, t).asc_nulls_last() for t in ties]).offset(offset).limit(limit)


def keyset_page(view: DataFrame, keys: list[str], after: list | None, limit: int = DEFAULT_LIMIT, descending: bool = False) -> DataFrame:
    """The rows after the key values ``after``: however deep the page, no row before it is sorted."""
    columns = [resolve(view, k) for k in keys]
    if after is not None:
        beyond = []
        for i, (c, v) in enumerate(zip(columns, after, strict=True)):
            same = [columns[j] == F.lit(after[j]) for j in range(i)]
            beyond.append(reduce(lambda a, b: a & b, [*same, c < F.lit(v) if descending else c > F.lit(v)]))
        view = view.filter(reduce(or_, beyond))
    return view.orderBy(*[c.desc_nulls_last() if descending else c.asc_nulls_last() for c in columns]).limit(limit)


def page_of(total: int, limit: int, offset: int) -> tuple[int, int]:
    """(current page from 1, pages) of a total count."""
    return offset // limit + 1, max(1, -(-total // limit))


def fill_counts(rows: DataFrame) -> DataFrame:
    """(field, filled): non-empty values of each column, in one pass."""
    fields = [f for f in rows.schema if f.name != SOURCE]
    counts = rows.agg(*[F.count_if((as_text(named(f.name), f.dataType) != "") & named(f.name).isNotNull()).alias(f"c{i}") for i, f in enumerate(fields)])
    pairs = F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f"c{i}").alias("filled"), F.lit(i).alias("at")) for i, f in enumerate(fields)])
    return counts.select(F.inline(pairs))


def column_order(rows: DataFrame, ts_field: str | None = None) -> DataFrame:
    """(field, filled, place): priority names first, then the fullest columns, ties as they stood."""
    first = [*dict.fromkeys([FIRST_COLUMNS[0], *([ts_field] if ts_field else []), *FIRST_COLUMNS[1:]])]
    rank = F.coalesce(*[F.when(F.col("field") == n, F.lit(i)) for i, n in enumerate(first)], F.lit(len(first)))
    placed = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.when(rank == len(first), -F.col("filled")).otherwise(F.lit(0)).alias("less"), "at", "field", "filled")))
    ordered = fill_counts(rows).agg(placed.alias("all"))  # one row a column of the view
    return ordered.select(F.posexplode("all").alias("place", "x")).select("x.field", "x.filled", "place")


def compact_json(rows: DataFrame) -> DataFrame:
    """(row): each row as JSON without its null and empty values."""
    fields = [f for f in rows.schema if f.name != SOURCE]
    entries = F.array(*[F.struct(F.lit(f.name).alias("k"), as_text(named(f.name), f.dataType).alias("v")) for f in fields])
    full = F.filter(entries, lambda e: e["v"].isNotNull() & ~e["v"].isin("", "[]", "{}"))
    return rows.select(F.to_json(F.map_from_entries(full)).alias("row"))


def visible(rows: DataFrame, hidden: list[str]) -> DataFrame:
    return rows.drop(*hidden, SOURCE)
