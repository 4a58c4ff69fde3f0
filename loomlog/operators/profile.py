"""Field profiles, value distributions and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.fields import SOURCE, resolve, text_field

MAX_FIELDS, MAX_VALUES, SAMPLE_CAP, MAX_SAMPLE_CAP = 200, 50, 30, 500
#: Fields aggregated in one job: wider aggregates outgrow generated code.
CHUNK = 100
#: Logarithm of the registers of a distinct-count sketch.
SKETCH_BITS = 12


def profile(view: DataFrame, fields: list[str] | None = None, exact: bool = False) -> DataFrame:
    """(field, present, distinct, sources, sources_total, total, fill, truncated): one scan for all fields of a chunk.

    present: values that are neither null nor empty.  sources: how many sources
    have one.  distinct comes from a mergeable sketch (about 2 % off); with
    ``exact`` distinct (field, value) pairs are counted, in a narrow shuffle of
    their own.  The default are all top-level columns; of more than MAX_FIELDS
    the first are profiled, and ``truncated`` is true in every row.
    """
    fields = [c for c in view.columns if c != SOURCE] if fields is None else fields
    out = None
    has_source = SOURCE in view.columns
    for lo in range(0, len(fields[:MAX_FIELDS]), CHUNK):
        part = fields[lo : min(lo + CHUNK, MAX_FIELDS)]
        texts = view.select(*[F.nullif(text_field(view, f), F.lit("")).alias(f"v{i}") for i, f in enumerate(part)], (F.col(SOURCE) if has_source else F.lit("")).alias("s"))
        if exact:
            rows = _exactly(texts, part)
        else:
            measured = [F.count("*").alias("total"), F.size(F.collect_set("s")).cast("long").alias("sources_total")]
            for i in range(len(part)):
                count = F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(f"v{i}", F.lit(SKETCH_BITS))), F.lit(0))
                measured += [F.count(f"v{i}").alias(f"p{i}"), count.alias(f"d{i}"), F.size(F.collect_set(F.when(F.col(f"v{i}").isNotNull(), F.col("s")))).alias(f"s{i}")]
            items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"p{i}").alias("present"), F.col(f"d{i}").alias("distinct"), F.col(f"s{i}").cast("long").alias("sources"), "sources_total", "total") for i, f in enumerate(part)])
            rows = texts.agg(*measured).select(F.inline(items))
        rows = rows.select("field", "present", "distinct", "sources", "sources_total", "total")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("fill", F.coalesce(F.try_divide("present", "total"), F.lit(0.0))).withColumn("truncated", F.lit(len(fields) > MAX_FIELDS))


def _exactly(texts: DataFrame, fields: list[str]) -> DataFrame:
    """``texts`` (v0, v1, ... of ``fields``, s): values are counted by source, and a source's rows
    make pairs only for the fields that it fills."""
    counted = texts.groupBy("s").agg(F.count("*").alias("n"), *[F.count(f"v{i}").alias(f"p{i}") for i in range(len(fields))])
    sums = [F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("s").alias("sources_total")]
    for i in range(len(fields)):
        sums += [F.coalesce(F.sum(f"p{i}"), F.lit(0)).alias(f"p{i}"), F.count_if((F.col(f"p{i}") > 0) & F.col("s").isNotNull()).alias(f"s{i}")]
    items = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(f).alias("field"), F.col(f"p{i}").alias("present"), F.col(f"s{i}").alias("sources"), "sources_total", "total") for i, f in enumerate(fields)])
    rows = counted.agg(*sums).select(F.inline(items))
    pairs = texts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.col(f"v{i}").alias("value")) for i in range(len(fields))])).alias("x")).filter(F.col("x.value").isNotNull())
    exactly = pairs.select("x.nth", "x.value").distinct().groupBy("nth").agg(F.count("*").alias("exactly"))
    return rows.join(F.broadcast(exactly), "nth", "left").withColumn("distinct", F.coalesce("exactly", F.lit(0)))  # CHUNK rows at most


def top_values(view: DataFrame, field: str, k: int = MAX_VALUES) -> DataFrame:
    """(value, n): the ``k`` most frequent non-empty values, ties by value; their sum is the total shown."""
    text = text_field(view, field)
    counts = view.select(text.alias("value")).filter("value IS NOT NULL AND value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(k)


def field_samples(view: DataFrame, fields: list[str], cap: int = SAMPLE_CAP) -> DataFrame:
    """(field, values): distinct non-empty values in order, none where there are more than ``cap``.

    All fields in one pass.  Values are dealt by field and hash and each share
    keeps cap + 1, so that a field of many values doesn't meet in one task.
    Fields that the view hasn't got are left out.
    """
    cap = min(cap, MAX_SAMPLE_CAP)
    known = []
    for f in fields:
        try:
            resolve(view, f)
            known.append(f)
        except KeyError:
            continue
    pairs = view.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text_field(view, f).alias("value")) for f in known])).alias("x")).select("x.field", "x.value")
    values = pairs.filter("value IS NOT NULL AND value <> ''").distinct()
    salted = Window.partitionBy("field", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy("value")
    few = values.withColumn("nth", F.row_number().over(salted)).filter(F.col("nth") <= cap + 1)
    kept = few.groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("values"))  # 64 (cap + 1) at most
    names = view.sparkSession.createDataFrame([(f,) for f in known], "field string")
    some = F.when(F.size("values") <= cap, F.col("values")).otherwise(F.array().cast("array<string>"))
    return names.join(kept, "field", "left").select("field", F.coalesce(some, F.array().cast("array<string>")).alias("values"))
