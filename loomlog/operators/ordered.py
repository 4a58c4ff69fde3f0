"""Running state over the lines of a file, without one task having to hold a file.

Lines are in order by (part, seq).  Each part is summed up on its own, the few
summaries of a file are added up in order, and each part then continues from
what stands before it.  Only summaries meet: one row a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a part, where parts are made from a sequence number.
PART_LINES = 100_000


def with_parts(lines: DataFrame, lines_per_part: int = PART_LINES) -> DataFrame:
    """Lines whose ``seq`` counts up from about 0 in each file, with ``part``."""
    return lines.withColumn("part", F.floor(F.col("seq") / lines_per_part).cast("long"))


def running_sums(lines: DataFrame, values: dict[str, Column], file: str = "file") -> DataFrame:
    """``lines`` with the sums of ``values`` (name: value) over this line and all before it in its file, in one pass."""
    held = lines.withColumns({f"__v_{n}": v.cast("long") for n, v in values.items()})
    sums = held.groupBy(file, "part").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    before = Window.partitionBy(file).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(file, "part", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in values])
    inside = Window.partitionBy(file, "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = held.withColumns({f"__v_{n}": F.sum(f"__v_{n}").over(inside) for n in values})
    joined = local.join(offsets, [file, "part"]).withColumns({n: F.col(f"__s_{n}") + F.col(f"__v_{n}") for n in values})
    return joined.drop(*[f"__{x}_{n}" for n in values for x in "vs"])


def running_sum(lines: DataFrame, value: Column, name: str, file: str = "file") -> DataFrame:
    """``lines`` with the sum of ``value`` over this line and all before it in its file."""
    return running_sums(lines, {name: value}, file)


def running_rollovers(lines: DataFrame, micros: Column, name: str, file: str = "file") -> DataFrame:
    """``lines`` with how many times the time of day has jumped back by over twelve hours so far.

    Lines whose ``micros`` is null don't take part.
    """
    half = 12 * 3600 * 1_000_000
    held = lines.withColumn("__t", micros)
    inside = Window.partitionBy(file, "part").orderBy("seq")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last("__t", ignorenulls=True).over(upto)
    held = held.withColumn("__roll", (F.col("__t") + half < prior).cast("long"))
    sums = held.groupBy(file, "part").agg(
        F.min_by("__t", F.when(F.col("__t").isNotNull(), F.col("seq"))).alias("__first"),
        F.max_by("__t", F.when(F.col("__t").isNotNull(), F.col("seq"))).alias("__last"),
        F.coalesce(F.sum("__roll"), F.lit(0)).alias("__inner"),
    )
    over = Window.partitionBy(file).orderBy("part")
    carried = F.last("__last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__entry", F.coalesce((F.col("__first") + half < carried).cast("long"), F.lit(0)))
    total = F.sum(F.col("__inner") + F.col("__entry")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(file, "part", (F.coalesce(total, F.lit(0)) + F.col("__entry")).alias("__from"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = held.withColumn("__local", F.coalesce(F.sum("__roll").over(so_far), F.lit(0)))
    return local.join(offsets, [file, "part"]).withColumn(name, F.col("__from") + F.col("__local")).drop("__t", "__roll", "__local", "__from")
