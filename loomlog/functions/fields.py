"""Field names over schemas that nobody agreed on: canonical names, struct paths, references.

Everything here reads ``df.schema`` only; no function runs a job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Struct paths longer than this are not listed.
MAX_PATH = 6
#: Hidden provenance column of a union.
SOURCE = "_source"

# Names that are taken for the timestamp, best first.
TIMESTAMP_NAMES = ("@timestamp", "timestamp", "time", "datetime", "date", "ts", "event_time", "created_at")


def named(column: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def canonical_names(schemas: Iterable[list[str]]) -> list[str]:
    """Names of all schemas, case folded: the first spelling wins, in order of first appearance."""
    seen: dict[str, str] = {}
    for names in schemas:
        for name in names:
            seen.setdefault(name.lower(), name)
    return list(seen.values())


def as_text(column: Column, kind: T.DataType) -> Column:
    """The text form of a value: structs and maps as JSON with their nulls, the rest cast."""
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    if isinstance(kind, (T.VariantType, T.BinaryType)):
        return column.cast("string")
    return column if isinstance(kind, T.StringType) else column.cast("string")


def struct_paths(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths below struct columns, inner nodes and leaves, at most MAX_PATH segments long."""
    out: list[tuple[str, ...]] = []
    for field in schema:
        path = (*prefix, field.name)
        if prefix:
            out.append(path)
        if isinstance(field.dataType, T.StructType) and len(path) < MAX_PATH:
            out.extend(struct_paths(field.dataType, path))
    return out


def list_fields(df: DataFrame) -> list[str]:
    """Top-level columns, then dotted struct paths that no earlier name equals when case is folded."""
    names = canonical_names([[c for c in df.columns if c != SOURCE]])
    seen = {n.lower() for n in names}
    for path in struct_paths(df.schema):
        dotted = ".".join(path)
        if dotted.lower() not in seen:
            seen.add(dotted.lower())
            names.append(dotted)
    return names


def resolve(df: DataFrame, name: str) -> Column:
    """A user's field name as a column: a top-level name first (case folded), then a struct path.

    Below a text column the rest of the path is looked up in its JSON.
    """
    by_fold = {c.lower(): c for c in reversed(df.columns)}
    if name.lower() in by_fold:
        return named(by_fold[name.lower()])
    parts = name.split(".")
    for cut in range(len(parts) - 1, 0, -1):
        head = ".".join(parts[:cut]).lower()
        if head not in by_fold:
            continue
        column, kind = named(by_fold[head]), df.schema[by_fold[head]].dataType
        for i, part in enumerate(parts[cut:], cut):
            if isinstance(kind, T.StructType):
                inner = next((f for f in kind if f.name.lower() == part.lower()), None)
                if inner is None:
                    break
                column, kind = column.getField(inner.name), inner.dataType
            elif isinstance(kind, T.StringType):
                return F.get_json_object(column, "$" + "".join(f"['{p}']" for p in parts[i:]))
            else:
                break
        else:
            return column
    raise KeyError(f"no field {name!r} among {', '.join(df.columns)}")


def text_field(df: DataFrame, name: str) -> Column:
    """The text form of a field reference."""
    column = resolve(df, name)
    return as_text(column, df.select(column.alias("x")).schema[0].dataType)


def pick_timestamp_field(columns: list[str]) -> str:
    """The column to take for the timestamp: by name, then by what the name contains, then the first."""
    folded = {c.lower(): c for c in reversed(columns)}
    for name in TIMESTAMP_NAMES:
        if name in folded:
            return folded[name]
    return next(iter(timestamp_like(columns)), columns[0] if columns else "@timestamp")


def timestamp_like(columns: list[str]) -> list[str]:
    """Columns whose name says time or date, or is ts."""
    return [c for c in columns if "time" in c.lower() or "date" in c.lower() or c.lower() == "ts"]
