"""What is known of Parquet files without reading their rows: an index kept beside them.

For each file, keyed by path, size and time of change: its rows; for each field its
filled values, first and last time, and a mergeable sketch of its distinct values;
and a bitmap of the trigrams of all its values in lower case.  ``refresh`` reads the files
that are new or changed and no others.  Profiles, bounds and counts come from the
index alone; a search reads only files whose bitmap has every trigram of the text.

A bitmap may have a trigram that the file hasn't (then the file is read in vain),
but never lacks one that it has, so no row is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.fields import as_text, named
from loomlog.operators.predicates import search
from loomlog.operators.profile import CHUNK, SKETCH_BITS
from loomlog.sources.loading import file_of_row
from loomlog.sources.scans import configure

#: Bytes of a piece of a bitmap (what ``bitmap_or_agg`` merges) and pieces of a file's bitmap.
PIECE, PIECES = 4096, 16
KEY = ("path", "size", "mtime")
BITS = "file string, piece int, bits binary"


def slots(data: np.ndarray) -> np.ndarray:
    """The bit of each trigram of some bytes."""
    b = data.astype(np.uint32)
    gram = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return (gram * np.uint32(2654435761)) >> np.uint32(32 - (PIECE * 8 * PIECES).bit_length() + 1)


class Index(NamedTuple):
    """``files``: the files as they are now; ``fields`` and ``grams``: what is known of them."""

    files: DataFrame
    fields: DataFrame
    grams: DataFrame


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, size, mtime), without reading any."""
    files = configure(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def _field_rows(rows: DataFrame, fields: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in rows.schema}
    aggs, items = [F.count("*").alias("total")], []
    for i, f in enumerate(fields):
        text = F.nullif(as_text(named(f), kinds[f]), F.lit(""))
        dated = isinstance(kinds[f], (T.TimestampType, T.TimestampNTZType, T.DateType))
        at = named(f).cast("timestamp_ntz") if dated else F.lit(None).cast("timestamp_ntz")
        aggs += [F.count(text).alias(f"p{i}"), F.hll_sketch_agg(text, F.lit(SKETCH_BITS)).alias(f"d{i}"), F.min(at).alias(f"a{i}"), F.max(at).alias(f"z{i}")]
        items.append(F.struct(F.lit(f).alias("field"), *[F.col(f"{x}{i}").alias(n) for x, n in (("p", "present"), ("d", "sketch"), ("a", "first"), ("z", "last"))]))
    return rows.groupBy("file").agg(*aggs).select("file", "total", F.inline(F.array(*items)))


def _gram_rows(rows: DataFrame, fields: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in rows.schema}
    text = F.lower(F.concat_ws("\n", *[as_text(named(f), kinds[f]) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name in batch.column(0).unique().to_pylist():
                mine = batch.filter(pa.compute.equal(batch.column(0), name)).column(1).cast(pa.large_string())
                data = np.frombuffer("\n".join(mine.to_pylist()).encode(), np.uint8)
                bits = held.setdefault(name, np.zeros(PIECE * 8 * PIECES, bool))
                if len(data) > 2:
                    bits[slots(data)] = True
        for name, bits in held.items():
            packed = np.packbits(bits).reshape(PIECES, PIECE)
            yield pa.RecordBatch.from_arrays([pa.array([name] * PIECES), pa.array(range(PIECES), pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())], names=["file", "piece", "bits"])

    found = rows.select("file", text.alias("text")).mapInArrow(run, BITS)
    return found.groupBy("file", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))


def refresh(spark: SparkSession, paths: Sequence[str], at: str) -> Index:
    """The index in folder ``at`` of the Parquet files below ``paths``, brought up to date.

    Entries of files as they were before stay in the folder, and are left out of what is returned.
    """
    files = list_files(spark, paths)
    known = [_read(spark, f"{at}/{part}") for part in ("fields", "grams")]
    fresh = files if known[0] is None else files.join(known[0].select(*KEY).distinct(), list(KEY), "left_anti")
    new = [r.path for r in fresh.collect()]  # a row a new file, as Spark's own listing
    if new:
        rows = spark.read.option("mergeSchema", "true").parquet(*new)
        names = rows.columns
        rows = rows.select(*[named(c) for c in names], file_of_row())
        now = files.filter(F.col("path").isin(new)) if len(new) < 1000 else fresh
        chunks = [_field_rows(rows, names[lo : lo + CHUNK]) for lo in range(0, len(names), CHUNK)]
        for part, found in (("grams", [_gram_rows(rows, names)]), ("fields", chunks)):  # fields last: they say what is known
            for one in found:
                now.join(one.withColumnRenamed("file", "path"), "path").write.mode("append").parquet(f"{at}/{part}")
        known = [_read(spark, f"{at}/{part}") for part in ("fields", "grams")]
    return Index(files, *[files.join(k, list(KEY)) for k in known])


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def profile(index: Index) -> DataFrame:
    """(field, present, distinct, total), distinct about 2 % off, of all files, from the index alone."""
    total = F.sum("total").alias("total")
    distinct = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("distinct")
    return index.fields.groupBy("field").agg(F.sum("present").alias("present"), distinct, total)


def bounds(index: Index) -> DataFrame:
    """(field, first_ts, last_ts) of fields that hold times."""
    return index.fields.groupBy("field").agg(F.min("first").alias("first_ts"), F.max("last").alias("last_ts")).filter("first_ts IS NOT NULL")


def may_hold(index: Index, text: str, literal: bool = False) -> DataFrame:
    """(path) of the files that may have ``text`` in some value; ``%`` and ``_`` stand for anything unless ``literal``."""
    pieces = [text] if literal else re.split(r"[%_\\]", text)
    lowered = index.files.sparkSession.createDataFrame([(p,) for p in pieces], "p string").select(F.lower("p")).collect()  # as Spark lowers
    wanted = np.unique(np.concatenate([np.zeros(0, np.uint32), *[slots(np.frombuffer(r[0].encode(), np.uint8)) for r in lowered if len(r[0].encode()) > 2]]))
    if not len(wanted):
        return index.files.select("path")
    has = F.lit(0)
    for slot in wanted.tolist():
        byte = F.conv(F.hex(F.substring("bits", slot // 8 % PIECE + 1, 1)), 16, 10).cast("int")
        has = has + F.when((F.col("piece") == slot // 8 // PIECE) & (byte.bitwiseAND(128 >> slot % 8) != 0), 1).otherwise(0)
    return index.grams.groupBy("path").agg(F.sum(has).alias("n")).filter(F.col("n") == len(wanted)).select("path")


def search_files(spark: SparkSession, index: Index, text: str, literal: bool = False) -> DataFrame:
    """The rows with ``text`` in any column, from files that may have it; with ``file``."""
    kept = [r.path for r in may_hold(index, text, literal).collect()]
    paths = kept or [r.path for r in index.files.limit(1).collect()]
    rows = spark.read.option("mergeSchema", "true").parquet(*paths)
    found = rows.filter(search(rows, text, literal) if kept else F.lit(False))
    return found.select("*", file_of_row())
