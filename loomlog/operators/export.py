"""Exports: NDJSON and Parquet, sorted by range so that no single task writes everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomlog.functions.fields import SOURCE
from loomlog.operators.pages import sort_column


#: Rows of a range, about, where there are more than fit the session's partitions at that size.
RANGE_ROWS = 250_000


def export(view: DataFrame, path: str, field: str | None = None, descending: bool = False) -> int:
    """Writes the rows in order of ``field`` and returns how many; ``.parquet``/``.pq`` by extension, else NDJSON.

    Files in name order are in sort order.  The count is taken while writing.  Rows that are
    equal in ``field``, or lack it, stay as they stood and are dealt over ranges like others.
    """
    column = sort_column(view, field)
    ranges = view.count() // RANGE_ROWS
    more = [ranges] if ranges > int(view.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    placed = view.withColumn("__key", column).withColumn("__nth", F.monotonically_increasing_id())
    order = [F.col("__key").desc_nulls_last() if descending else F.col("__key").asc_nulls_last(), F.col("__nth").asc()]
    rows = placed.repartitionByRange(*more, *order).sortWithinPartitions(*order).drop("__key", "__nth", SOURCE)
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    if path.lower().rstrip("/").endswith((".parquet", ".pq")):
        rows.write.option("compression", "zstd").parquet(path)
    else:
        rows.write.option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def stage(view: DataFrame, path: str, ts_field: str, format_field: str = "_source_format") -> None:
    """Parquet laid out by source format and day, for pruning by both."""
    day = F.to_date(F.substring(F.col(f"`{ts_field}`").cast("string"), 1, 10))
    laid = view.withColumn("event_date", day)
    laid.repartition(F.col(format_field), F.col("event_date"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in view.columns]), F.lit(8))).write.partitionBy(format_field, "event_date").parquet(path)
