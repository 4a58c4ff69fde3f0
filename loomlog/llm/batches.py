"""Helpers that every operator here shares: Arrow maps over whole texts, and lineage cuts.

Texts reach Python as Arrow batches bounded by bytes, are worked on with numpy
in slices of a few megabytes, and go back as Arrow columns.  A text is never
split between slices, so a single very long text makes one large slice.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: UTF-8 bytes of text worked on at once inside a task.
SLICE_BYTES = 1 << 20
#: Most texts in a slice: shingle keys hold the text's place in 12 bits.
SLICE_TEXTS = 4096


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker is sent at once, also where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes and SLICE_TEXTS rows (one row at least)."""
    lengths = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (size + n > most or i - start >= SLICE_TEXTS):
            yield start, i
            start, size = i, 0
        size += n
    if len(lengths) > start:
        yield start, len(lengths)


def fresh(taken: Sequence[str], name: str) -> str:
    """``name``, with underscores after it until no column has it."""
    folded = {c.lower() for c in taken}
    while name.lower() in folded:
        name += "_"
    return name


def map_texts(
    df: DataFrame,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., list[pa.Array]]],
    text: str = "text",
    keep: Sequence[str] | None = None,
    slice_bytes: int = SLICE_BYTES,
    beside: str | None = None,
) -> DataFrame:
    """Adds ``fields``, computed from the text column, to the columns ``keep`` (default: all).

    ``make`` is called once a task and returns the function from a slice of
    texts (nulls are empty strings), and of the kept column ``beside`` if there
    is one, to one Arrow array a field.  A kept column that has the name of a
    new field is replaced.
    """
    bounded_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    work = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(fresh(kept, "__text")))
    schema = T.StructType([*[work.schema[c] for c in kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.string()).fill_null("")
            for lo, hi in slices(texts, slice_bytes):
                part = batch.slice(lo, hi - lo)
                columns = [part.column(i) for i in range(len(kept))]
                more = [] if beside is None else [columns[kept.index(beside)]]
                yield pa.RecordBatch.from_arrays([*columns, *fn(texts.slice(lo, hi - lo), *more)], names=schema.names)

    return work.mapInArrow(run, schema)


def gather_texts(
    df: DataFrame,
    schema: T.StructType,
    make: Callable[[], tuple[Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], Callable[[], Iterator[pa.RecordBatch]]]],
) -> DataFrame:
    """A partial aggregate in numpy: ``make`` gives ``(add, finish)`` for one task.

    The last column of ``df`` is the text; ``add`` sees slices of the batches.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, finish = make()
        for batch in batches:
            for lo, hi in slices(batch.column(batch.num_columns - 1)):
                yield from add(batch.slice(lo, hi - lo))
        yield from finish()

    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, even where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomlog-checkpoint-")
    context.setCheckpointDir(path)
    return path


#: Spark's own setting: an execution's shuffle files go when it ends, not when the driver collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders that ``cut`` has written and nothing has deleted.
_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed now and read again as Parquet from the shared folder: lost executors don't lose it.

    What was shuffled for it is deleted once it is written.
    """
    path = f"{shared_dir(df.sparkSession)}/loomlog-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEAN_UP, before)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is; a missing one is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*cuts: DataFrame) -> None:
    """Deletes the files of frames made by ``cut`` that nothing reads any more."""
    for df in cuts:
        delete(df.sparkSession, df.cut_path)
        if df.cut_path in _written:
            _written.remove(df.cut_path)


def free_shuffles(spark: SparkSession) -> None:
    """Collects Python's and the driver's garbage now: Spark deletes shuffle files once the frames
    that wrote them are collected, which a driver with memory to spare may put off for half an hour."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was cut inside; results must have been written by then."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            delete(spark, path)
        del _written[before:]
