"""Decoded event records: nested structs to dotted columns, timestamps from Unix seconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.fields import named
from loomlog.functions.times import iso
from loomlog.operators.lines import FORMAT, TIMESTAMP


def lists(kind: T.DataType, path: str = "") -> list[tuple[str, Callable[[Column], Column]]]:
    """(path, function from the value to its size) of every list; an item is ``path.*``, and the longest counts."""
    out: list[tuple[str, Callable[[Column], Column]]] = []
    if isinstance(kind, T.StructType):
        for field in kind:
            for p, size in lists(field.dataType, f"{path}.{field.name}" if path else field.name):
                out.append((p, lambda c, name=field.name, size=size: size(c.getField(name))))
    elif isinstance(kind, T.ArrayType):
        out.append((path, F.size))
        for p, size in lists(kind.elementType, f"{path}.*"):
            out.append((p, lambda c, size=size: F.array_max(F.transform(c, lambda x: size(x)))))
    return out


def list_sizes(records: DataFrame) -> dict[str, int]:
    """The most items of every list, from one aggregate."""
    found = [(p, size(named(f.name))) for f in records.schema for p, size in lists(f.dataType, f.name)]
    if not found:
        return {}
    most = records.agg(*[F.max(size).alias(f"n{i}") for i, (_, size) in enumerate(found)]).first()
    return {p: max(n or 0, 0) for (p, _), n in zip(found, most, strict=True)}


def leaves(kind: T.DataType, sizes: dict[str, int], column: Column | None = None, path: str = "", shape: str = "") -> list[tuple[str, Column]]:
    """(dotted path, column) of every leaf; items of a list are ``path.N``, as many as ``sizes`` says; empty structs give none."""
    if isinstance(kind, T.StructType):
        out: list[tuple[str, Column]] = []
        for field in kind:
            c = named(field.name) if column is None else column.getField(field.name)
            out += leaves(field.dataType, sizes, c, f"{path}.{field.name}" if path else field.name, f"{shape}.{field.name}" if shape else field.name)
        return out
    if isinstance(kind, T.ArrayType):
        return [x for i in range(sizes[shape]) for x in leaves(kind.elementType, sizes, F.get(column, F.lit(i)), f"{path}.{i}", f"{shape}.*")]
    return [(path, column)]


def unix_timestamp(seconds: Column, mtime: Column) -> Column:
    """A float of Unix seconds as a timestamp; the file's time where it is missing, not finite or not positive."""
    usable = (seconds > 0) & ~F.isnan(seconds) & (seconds < 1e12)
    return F.coalesce(F.when(usable, F.timestamp_micros(F.round(seconds * 1_000_000).cast("long"))), mtime.cast("timestamp"))


def flatten_events(records: DataFrame, seconds: str, mtime: str = "mtime", label: str = "evtx") -> DataFrame:
    """Every leaf of nested records as a column of its path, with timestamp and format.

    Lists get a column for each item of the longest one, which an aggregate finds.
    """
    flat = [(p, c) for p, c in leaves(records.schema, list_sizes(records)) if p != mtime]
    by_path = dict(flat)
    ts = unix_timestamp(by_path[seconds].cast("double"), named(mtime))
    return records.select(*[c.alias(p) for p, c in flat], iso(ts).alias(TIMESTAMP), F.lit(label).alias(FORMAT))
