"""Block records: key and value lines between separator lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.times import iso, parse_layout
from loomlog.operators.lines import FORMAT, TIMESTAMP, is_blank
from loomlog.operators.ordered import running_sums
from loomlog.operators.rules import BlockRule


def first_timestamp(candidates: list[Column], layouts: tuple[str, ...]) -> Column:
    """The first candidate that isn't empty and reads by any layout."""
    return F.coalesce(*[parse_layout(F.nullif(F.trim(c), F.lit("")), layout) for c in candidates for layout in layouts], F.lit(None).cast("timestamp"))


def block_entries(lines: DataFrame, rule: BlockRule) -> DataFrame:
    """(file, rid, key, value): one row a key of a record.

    A separator line opens a record; lines before the first one, and lines of a
    record before its first key, are dropped.  Other lines that aren't blank
    continue the value before them.  Of a key that comes twice the last value stays.
    """
    value = F.col("value")
    marked = lines.withColumn("__sep", value.rlike(rule.separator))
    marked = marked.withColumn("__key", ~F.col("__sep") & value.rlike(rule.field_pattern))
    numbered = running_sums(marked, {"rid": F.col("__sep").cast("long"), "__kid": F.col("__key").cast("long")})
    kept = numbered.filter((F.col("rid") > 0) & ~F.col("__sep") & (F.col("__key") | ~is_blank(value)))
    part = F.struct("part", "seq", F.when(F.col("__key"), F.regexp_extract(value, rule.field_pattern, 2)).otherwise(value).alias("text"))
    fields = kept.groupBy("file", "rid", "__kid").agg(
        F.max(F.when(F.col("__key"), F.rtrim(F.regexp_extract(value, rule.field_pattern, 1)))).alias("key"), F.array_sort(F.collect_list(part)).alias("parts")
    )
    entries = fields.filter(F.col("key").isNotNull()).select("file", "rid", "__kid", "key", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("value"))
    return entries.groupBy("file", "rid", "key").agg(F.max_by("value", "__kid").alias("value"))


def parse_blocks(lines: DataFrame, rule: BlockRule) -> DataFrame:
    """(file, rid, fields: map, @timestamp, _source_format); records without a field don't appear."""
    records = block_entries(lines, rule).groupBy("file", "rid").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fields"))
    ts = first_timestamp([F.try_element_at("fields", F.lit(f)) for f in rule.ts_field], rule.ts_layouts)
    return records.withColumn(TIMESTAMP, iso(ts)).withColumn(FORMAT, F.lit(f"block:{rule.name}"))


def widen(records: DataFrame, keys: list[str] | None = None, column: str = "fields") -> DataFrame:
    """A map column as columns; without ``keys`` they are found in a job of their own, in order of name."""
    if keys is None:
        found = records.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k")
        keys = [r.k for r in found.toLocalIterator()]
    return records.select(*[c for c in records.columns if c != column], *[F.try_element_at(column, F.lit(k)).alias(k) for k in keys])
