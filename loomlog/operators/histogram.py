"""Time bounds and time histograms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.fields import as_text, resolve
from loomlog.functions.times import ORIGIN, WIDTHS, bucket, pick_width, since_origin, text_to_timestamp


def timestamps(view: DataFrame, field: str) -> Column:
    """A field as naive UTC timestamps: native types as they are, text where it reads as a date."""
    column = resolve(view, field)
    kind = view.select(column.alias("x")).schema[0].dataType
    if isinstance(kind, T.TimestampNTZType):
        return column
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return column.cast("timestamp_ntz")
    return text_to_timestamp(as_text(column, kind))


def time_bounds(view: DataFrame, field: str) -> DataFrame:
    """One row: min_ts, max_ts."""
    ts = timestamps(view, field)
    return view.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def histogram(view: DataFrame, field: str, width: int | None = None) -> DataFrame:
    """(bucket, n) in order; the width in seconds follows from the span of the rows unless given.

    A first job finds the span, a second counts; no rows give no buckets, and
    the counts add up to the rows that have a timestamp.
    """
    rows = view.select(timestamps(view, field).alias("ts")).filter("ts IS NOT NULL")
    if width is None:
        lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
        width = 1 if lo is None else max(1, pick_width(int((hi - lo).total_seconds())))
    return rows.groupBy(bucket(F.col("ts"), width).alias("bucket")).agg(F.count("*").alias("n")).orderBy("bucket")


@cache
def fine_width(seconds: int) -> int:
    """The greatest width that divides every bucket width that this span, or a larger one, may get."""
    least = pick_width(seconds)
    return gcd(86400, *[w for w in WIDTHS if w >= least])


class Pyramid:
    """Counts in fine buckets that widen as the span of what was added grows; times are seconds since ORIGIN."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.lo = self.hi = None
        self.width = 1

    def add(self, starts: np.ndarray, counts: np.ndarray, lo: int, hi: int) -> None:
        """``counts`` of times or of buckets that begin at ``starts``, which all lie from ``lo`` to ``hi`` (microseconds)."""
        self.lo, self.hi = (lo, hi) if self.lo is None else (min(lo, self.lo), max(hi, self.hi))
        self.widen(fine_width((self.hi - self.lo) // 1_000_000))
        places, nth = np.unique(starts // self.width * self.width, return_inverse=True)
        for start, n in zip(places.tolist(), np.bincount(nth.ravel(), counts, len(places)).astype(np.int64).tolist(), strict=True):
            self.counts[start] = self.counts.get(start, 0) + n

    def widen(self, width: int) -> None:
        if width != self.width:
            held, self.counts, self.width = self.counts, {}, width
            for start, n in held.items():
                at = start // width * width
                self.counts[at] = self.counts.get(at, 0) + n

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.counts:
            n = len(self.counts)
            columns = [list(self.counts), list(self.counts.values()), [self.lo] * n, [self.hi] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["start", "n", "lo", "hi"])


def one_pass_histogram(view: DataFrame, field: str) -> DataFrame:
    """(bucket, n) as ``histogram`` without a width gives, from one scan; eager.

    Each task counts in fine buckets that nest in whatever width the whole span will get,
    some hundred rows for any number of timestamps.  These are added up by bucket, and each
    share of them is put into a pyramid again, so that what comes to the driver is some
    hundred rows a shuffle partition, whatever the data.
    """
    spark, origin = view.sparkSession, F.lit(ORIGIN).cast("timestamp_ntz")
    rows = view.select(F.timestamp_diff("MICROSECOND", origin, timestamps(view, field)).alias("at")).filter("at IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pyramid = Pyramid()
        for batch in batches:
            if batch.num_rows:
                at = batch.column(0).to_numpy()
                pyramid.add(at // 1_000_000, np.ones(len(at)), int(at.min()), int(at.max()))
        yield from pyramid.batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pyramid = Pyramid()
        for batch in batches:
            if batch.num_rows:
                start, n, lo, hi = (c.to_numpy() for c in batch.columns)
                pyramid.add(start, n, int(lo.min()), int(hi.max()))
        yield from pyramid.batch()

    kind = "start long, n long, lo long, hi long"
    sums = rows.mapInArrow(count, kind).groupBy("start").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = Pyramid()
    for r in sums.mapInArrow(merge, kind).collect():
        whole.add(np.array([r.start]), np.array([r.n]), r.lo, r.hi)
    if whole.counts:
        whole.widen(pick_width((whole.hi - whole.lo) // 1_000_000) or 1)
    found = spark.createDataFrame(sorted(whole.counts.items()), "start long, n long")
    return found.select(since_origin(F.col("start")).alias("bucket"), "n").orderBy("bucket")


def with_shares(counts: DataFrame, total: int, name: str = "n") -> DataFrame:
    """``counts`` with ``share`` of a total (0 for a total of 0)."""
    return counts.withColumn("share", F.coalesce(F.try_divide(F.col(name), F.lit(total)), F.lit(0.0)))
