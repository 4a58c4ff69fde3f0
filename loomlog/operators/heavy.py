"""Exact top values without a shuffle of all distinct values.

1. Every task keeps a summary of bounded size of the values it sees: counts that are too low by at
   most its ``error`` (merged Misra-Gries summaries, as Space-Saving keeps them).  They add up to
   counts that are too low by at most the sum E of the errors.
2. Let T be the k-th highest such count.  A value whose count plus E is under T is none of the top k;
   the others are the candidates.  If E itself is T or more, an unseen value might be, and nothing is proven.
3. The candidates alone are counted exactly, in a second scan with a broadcast of at most CANDIDATES values.

Where nothing is proven, as where all values are about as frequent, all values are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.fields import text_field
from loomlog.operators.profile import MAX_VALUES, top_values

#: Values that a task's summary holds, and candidates that are broadcast (their bytes are bounded below).
HELD, CANDIDATES, CANDIDATE_BYTES = 8192, 10_000, 8 << 20
SUMMARY = "value string, n bigint, error bigint"


class Summary:
    """Counts of at most ``held`` values; each is too low by ``error`` at most."""

    def __init__(self, held: int = HELD):
        self.held, self.counts, self.error = held, {}, 0

    def add(self, values: list[str], counts: list[int]) -> None:
        mine = self.counts
        for value, n in zip(values, counts, strict=True):
            mine[value] = mine.get(value, 0) + n
        if len(mine) > 2 * self.held:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.held:
            off = sorted(self.counts.values(), reverse=True)[self.held]
            self.counts = {v: n - off for v, n in self.counts.items() if n > off}
            self.error += off


def summaries(values: DataFrame, held: int = HELD) -> DataFrame:
    """(value, n, error) of one text column: a summary a task, and one row with a null value that carries its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(held)
        for batch in batches:
            counted = pa.compute.value_counts(batch.column(0).drop_null())
            summary.add(counted.field("values").to_pylist(), counted.field("counts").to_pylist())
        summary.shrink()
        names, counts = [*summary.counts, None], [*summary.counts.values(), 0]
        errors = [*[0] * len(summary.counts), summary.error]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(errors, pa.int64())], names=["value", "n", "error"])

    return values.mapInArrow(run, SUMMARY)


def candidates(values: DataFrame, k: int, held: int = HELD) -> DataFrame | None:
    """(value): all values that may be among the ``k`` most frequent; None where the summaries can't tell.

    The summaries' rows, HELD a task at most, are added up by value; the values of
    highest counts come to the driver.
    """
    added = summaries(values, held).groupBy("value").agg(F.sum("n").alias("n"), F.sum("error").alias("error"))
    found = added.orderBy(F.col("value").isNotNull(), F.desc("n")).limit(CANDIDATES + 1).collect()
    error = sum(r.error for r in found if r.value is None)
    seen = [(r.value, r.n) for r in found if r.value is not None]
    if len(seen) <= k and not error:
        kept = seen
    else:
        if len(seen) < k or error >= seen[k - 1][1]:
            return None
        kept = [(v, n) for v, n in seen if n + error >= seen[k - 1][1]]
        if len(kept) >= CANDIDATES or sum(len(v.encode()) for v, _ in kept) > CANDIDATE_BYTES:
            return None
    return values.sparkSession.createDataFrame([(v,) for v, _ in kept], "value string")


def heavy_hitters(view: DataFrame, field: str, k: int = MAX_VALUES, held: int = HELD) -> DataFrame:
    """(value, n): as ``top_values``, the ``k`` most frequent non-empty values, ties by value, counts exact."""
    values = view.select(text_field(view, field).alias("value")).filter("value IS NOT NULL AND value <> ''")
    some = candidates(values, k, held)
    if some is None:
        return top_values(view, field, k)
    counts = values.join(F.broadcast(some), "value").groupBy("value").agg(F.count("*").alias("n"))  # CANDIDATES rows at most
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(k)
