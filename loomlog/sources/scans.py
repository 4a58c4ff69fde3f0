"""Readers: each gives one lazy DataFrame for any number of files of one format."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.sources.heads import HeadSource, opened

#: Longer lines are dropped whole.
MAX_LINE_BYTES = 16 << 20


def configure(spark: SparkSession) -> SparkSession:
    """UTC and exact column names: what everything here assumes, set at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.caseSensitive", "true")
    return spark


def read_ndjson(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None, sampling_ratio: float | None = None) -> DataFrame:
    """One JSON object a line; lines that aren't are left out.  Without a schema types are inferred."""
    reader = configure(spark).read.option("mode", "DROPMALFORMED").option("inferTimestamp", "true").option("recursiveFileLookup", "true")
    if sampling_ratio is not None:
        reader = reader.option("samplingRatio", sampling_ratio)
    return (reader.schema(schema) if schema is not None else reader).json(paths)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return configure(spark).read.parquet(*paths)


def read_lines(spark: SparkSession, paths: str | Sequence[str], max_bytes: int = MAX_LINE_BYTES, **options: str) -> DataFrame:
    """(file, part, seq, mtime, value): lines with their order in the file.

    ``part`` is where the split of the file begins, ``seq`` grows within a split:
    lines of one file are in order by (part, seq).  The byte order mark and
    carriage returns are taken off by the reader.  Overlong lines are dropped.
    """
    raw = configure(spark).read.options(**options).text(paths if isinstance(paths, str) else list(paths))
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        "value",
    )
    return lines.filter(F.octet_length("value") <= max_bytes)


def count_overlong(spark: SparkSession, paths: str | Sequence[str], max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """(file, n_overlong) of files with lines that ``read_lines`` drops."""
    raw = configure(spark).read.text(paths if isinstance(paths, str) else list(paths))
    return raw.select(F.col("_metadata.file_path").alias("file"), "value").filter(F.octet_length("value") > max_bytes).groupBy("file").agg(F.count("*").alias("n_overlong"))


def read_decoded_events(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, damaged) of files with one decoded event record a line.

    records: file, mtime and the columns of ``schema``.  damaged: (file,
    n_damaged, n_read); lines that can't be read are left out.  It is an error
    only if no line of any file can be read, and some can't.
    """
    names = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = "__damaged"
    raw = configure(spark).read.text(paths if isinstance(paths, str) else list(paths)).filter("trim(value) <> ''")
    read = F.from_json("value", T.StructType([*names, T.StructField(bad, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"), read.alias("r")).select("file", "mtime", "r.*")
    counts = rows.groupBy("file").agg(F.count_if(F.col(bad).isNotNull()).alias("n_damaged"), F.count_if(F.col(bad).isNull()).alias("n_read"))
    lost, good = counts.agg(F.coalesce(F.sum("n_damaged"), F.lit(0)), F.coalesce(F.sum("n_read"), F.lit(0))).first()
    if lost and not good:
        raise ValueError(f"none of {lost} event records can be read")
    return rows.filter(F.col(bad).isNull()).drop(bad), counts.filter("n_damaged > 0")


def read_heads(spark: SparkSession, paths: str | Sequence[str], head_bytes: int = 1 << 20) -> DataFrame:
    """(path, size, mtime, head, problem): the first bytes of every file, empty files too, for format detection.

    Only ``head_bytes`` of a file are read (``HeadSource``).  In a store that pyarrow
    doesn't reach Spark's own reader stands in, which reads files whole and leaves out empty ones.
    """
    configure(spark).dataSource.register(HeadSource)
    wanted = [paths] if isinstance(paths, str) else list(paths)
    try:
        for path in wanted:
            opened(path)
    except (OSError, pa.ArrowException):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(wanted)
        return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.substring("content", 1, head_bytes).alias("head"), F.lit(None).cast("string").alias("problem"))
    return spark.read.format("file_heads").option("paths", json.dumps(wanted)).option("head_bytes", head_bytes).load()


def unreadable(heads: DataFrame) -> DataFrame:
    """(path, reason) of files that their format's reader would refuse, from ``heads``; the others can be loaded.

    A Parquet name without the signature, NDJSON that begins with no object, and
    NUL bytes in what should be text.
    """
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    text = F.decode(F.substring("head", 1, 4096), "ISO-8859-1")
    parquet, ndjson = ext.isin(".parquet", ".pq"), ext.isin(".ndjson", ".jsonl")
    reason = (
        F.when(F.col("head").isNull() | (F.col("size") == 0), None)
        .when(parquet & (F.substring("head", 1, 4) != F.lit(b"PAR1")), F.lit("no Parquet signature"))
        .when(~parquet & F.contains(text, F.lit("\x00")) & (F.substring("head", 1, 4) != F.lit(b"PAR1")) & (F.substring("head", 1, 8) != F.lit(b"ElfFile\x00")), F.lit("NUL bytes in text"))
        .when(ndjson & ~F.regexp_replace(text, "^(\u00ef\u00bb\u00bf)?\\s*", "").startswith("{"), F.lit("no JSON object"))
    )
    return heads.select("path", reason.alias("reason")).filter("reason IS NOT NULL")
