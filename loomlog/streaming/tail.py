"""Line logs as a stream: single-line parsing, filters, and counts in event time.

Headers are parsed by the same expressions as in batch jobs.  Folding and
rollover need a file's order and are batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.times import parse_layout
from loomlog.operators.lines import captures, is_header, rewritten
from loomlog.operators.rules import LineRule
from loomlog.sources.scans import configure


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files that appear in a folder."""
    return configure(spark).readStream.format("text").load(path)


def parse_stream(lines: DataFrame, rule: LineRule) -> DataFrame:
    """Captured fields and the timestamp ``ts`` of header lines."""
    if rule.ts_use_mtime_date or rule.ts_use_mtime_year:
        raise ValueError(f"{rule.name} takes its date from the file and needs a batch job")
    got = captures(F.col("value"), rule)
    ts = parse_layout(rewritten(got.pop("ts"), rule), rule.ts_layout, rule.ts_assume_tz)
    return lines.filter(is_header(F.col("value"), rule)).select(ts.alias("ts"), *[c.alias(g) for g, c in got.items()])


def stream_histogram(records: DataFrame, width: str, lateness: str, *keys: str) -> DataFrame:
    """Counts by window of ``width`` (and keys); rows later than ``lateness`` are left out."""
    counts = records.withWatermark("ts", lateness).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("bucket"), *keys, "n")
