"""Bulk loads that go on past bad files: the rows of the good ones, and a row with the reason for each bad one.

Whether a file is bad is found by reading all of it, not from its head: a
Parquet file has to give as many rows, all columns decoded, as its footer
states, an NDJSON file has to hold one JSON object a line.  Statuses are
aggregates a file over one scan; rows come from a second, lazy scan without
those of bad files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.operators.detect import classify_files
from loomlog.sources.heads import opened
from loomlog.sources.scans import configure, read_heads

FOOTER = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_rows", T.LongType()), T.StructField("reason", T.StringType())])
#: Enough of a file to tell its format.
SNIFFED = 16 << 10


class Loaded(NamedTuple):
    """``rows`` (with ``file``) of the good files; ``problems``: (path, reason) of the others."""

    rows: DataFrame
    problems: DataFrame


def file_of_row() -> Column:
    """The path of a row's file, as listings write it."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:///").alias("file")


def footers(files: DataFrame) -> DataFrame:
    """(path, n_rows, reason) of Parquet files (``files``: path), from their last bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, reasons = [], []
            for path in batch.column(0).to_pylist():
                count = reason = None
                try:
                    system, inside = opened(path)
                    with system.open_input_file(inside) as held:
                        count = pyarrow.parquet.ParquetFile(held).metadata.num_rows
                except (OSError, pa.ArrowException) as error:
                    reason = f"no Parquet footer: {str(error).splitlines()[0][:200]}"
                counts.append(count)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(reasons, pa.string())], names=FOOTER.names)

    return files.select("path").mapInArrow(run, FOOTER)


def _without(rows: DataFrame, problems: DataFrame) -> DataFrame:
    return rows.join(problems.select(F.col("path").alias("file")), "file", "left_anti")


def load_parquet(spark: SparkSession, paths: Sequence[str]) -> Loaded:
    """All rows of the Parquet files that can be read whole, their schemas merged."""
    files = configure(spark).createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism)))
    ends = footers(files)
    sound = [r.path for r in ends.filter("reason IS NULL").collect()]  # paths, as Spark's own listing holds them
    if not sound:
        return Loaded(spark.createDataFrame([], "file string"), ends.select("path", "reason"))
    read = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(*sound)
    counted = read.select(file_of_row(), F.xxhash64(*[F.col(f"`{c}`") for c in read.columns]).alias("row")).groupBy("file").agg(F.count("*").alias("n_read"), F.bit_xor("row").alias("mixed"))
    short = F.concat(F.lit("only "), F.coalesce("n_read", F.lit(0)).cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit(" rows can be read"))
    # that all values were mixed is asked for, as columns nobody asks for aren't decoded
    less = (F.coalesce("n_read", F.lit(0)) < F.col("n_rows")) | (F.col("mixed").isNull() & (F.col("n_rows") > 0))
    reason = F.coalesce("reason", F.when(less, short)).alias("reason")
    problems = ends.join(counted.withColumnRenamed("file", "path"), "path", "left").select("path", reason).filter("reason IS NOT NULL")
    return Loaded(_without(read.select("*", file_of_row()), problems), problems)


def load_ndjson(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str | None = None) -> Loaded:
    """All rows of the NDJSON files whose lines are all JSON objects; blank lines don't count.

    Without a schema it is inferred from all lines of all files.
    """
    raw = configure(spark).read.text(list(paths)).select(file_of_row(), "value", F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("seq"))
    lines = raw.withColumn("value", F.regexp_replace("value", "^﻿", "")).filter(r"value RLIKE '\\S'")
    kinds = F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    bad = lines.withColumn("bad", ~F.coalesce(kinds, F.lit(False)))
    first = F.min(F.when(F.col("bad"), F.struct("part", "seq", F.substring("value", 1, 60).alias("text")))).getField("text").alias("text")
    counted = bad.groupBy("file").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), first)
    reason = F.concat(F.col("n_bad").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" lines are no JSON objects, first: "), "text")
    problems = counted.filter("n_bad > 0").select(F.col("file").alias("path"), reason.alias("reason"))
    good = _without(lines.select("file", "value"), problems)
    if schema is None:
        schema = spark.read.option("mode", "DROPMALFORMED").option("inferTimestamp", "true").json(list(paths)).schema
    names = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return Loaded(good.select("file", F.from_json("value", names).alias("r")).select("r.*", "file"), problems)


def load_files(spark: SparkSession, paths: str | Sequence[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """({format: rows of its good files}, (path, reason) of the bad files) of everything below ``paths``.

    Formats are told by content; files that no format fits, empty ones and those
    that can't be opened are bad files.
    """
    heads = read_heads(spark, paths, SNIFFED)
    found = classify_files(heads).join(heads.select("path", "size", "problem"), "path")
    named = F.when(F.lower("path").rlike(r"\.(parquet|pq)$"), F.lit("parquet")).otherwise(F.col("adapter"))
    reason = F.coalesce("problem", F.when(F.col("size") == 0, F.lit("empty file")), F.when(named.isNull(), F.lit("no format fits")))
    rows = found.select("path", named.alias("format"), reason.alias("reason")).collect()  # a row a file, as Spark's own listing
    loaded: dict[str, DataFrame] = {}
    problems = spark.createDataFrame([(r.path, r.reason) for r in rows if r.reason], "path string, reason string")
    for kind, load in (("parquet", load_parquet), ("ndjson", load_ndjson)):
        mine = [r.path for r in rows if r.format == kind and not r.reason]
        if mine:
            loaded[kind], bad = load(spark, mine)
            problems = problems.unionByName(bad)
    for kind in ("line", "block", "xml", "evtx"):
        mine = [r.path for r in rows if r.format == kind and not r.reason]
        if mine:
            loaded[kind] = spark.read.text(mine).select("value", file_of_row())
    return loaded, problems
