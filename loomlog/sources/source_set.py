"""An ordered set of sources, and the union views over the enabled ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.fields import pick_timestamp_field, timestamp_like
from loomlog.functions.times import text_to_timestamp
from loomlog.operators.union import union_view


@dataclass
class Source:
    name: str
    df: DataFrame
    path: str | None = None
    enabled: bool = True


class SourceSet:
    """Sources by name.  Nothing is read or kept: a view is built anew from what is enabled."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[str, Source] = {}
        self._timestamp: str | None = None

    def add(self, name: str, df: DataFrame, path: str | None = None) -> SourceSet:
        """The same name or the same path twice is an error."""
        canonical = path and self.canonical_path(path)
        if name in self.sources or canonical and any(s.path == canonical for s in self.sources.values()):
            raise ValueError(f"source {path or name} is already there")
        self.sources[name] = Source(name, df, canonical)
        return self

    def canonical_path(self, path: str) -> str:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(found).toString()

    def drop(self, name: str) -> SourceSet:
        self.sources.pop(name).df.unpersist()
        return self

    def enable(self, name: str, enabled: bool = True) -> SourceSet:
        self.sources[name].enabled = enabled
        return self

    def enabled(self) -> dict[str, DataFrame]:
        return {s.name: s.df for s in self.sources.values() if s.enabled}

    def view(self, mode: str = "text") -> DataFrame:
        return union_view(self.enabled(), mode)

    @property
    def timestamp_field(self) -> str:
        """Set, or picked over the merged schema of the enabled sources."""
        return self._timestamp or pick_timestamp_field([c for c in self.view().columns if c != "_source"])

    @timestamp_field.setter
    def timestamp_field(self, name: str | None) -> None:
        self._timestamp = name

    def files_declaring(self) -> dict[str, int]:
        """How many enabled sources declare each field (case folded), from schemas alone."""
        out: dict[str, int] = {}
        for df in self.enabled().values():
            for name in {c.lower() for c in df.columns}:
                out[name] = out.get(name, 0) + 1
        return out

    def size(self, path: str) -> int | None:
        """Bytes under a path, from the store's own listing; None if nothing is there."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        store = found.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return store.getContentSummary(found).getLength() if store.exists(found) else None

    def listing(self) -> DataFrame:
        """(source, path, enabled, bytes, records, first_ts, last_ts), counted in one job over all sources.

        Bounds are of each source's own timestamp column, as text in UTC.
        """
        known = self.spark.createDataFrame([(s.name, s.path, s.enabled, s.path and self.size(s.path)) for s in self.sources.values()], "source string, path string, enabled boolean, bytes long")
        rows = None
        for s in self.sources.values():
            found = timestamp_like(s.df.columns)
            ts = s.df[f"`{pick_timestamp_field(s.df.columns)}`"] if found or "@timestamp" in s.df.columns else F.lit(None)
            ts = text_to_timestamp(ts.cast("string"))
            one = s.df.select(F.lit(s.name).alias("source"), ts.alias("ts"))
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            return known.select("*", F.lit(0).cast("long").alias("records"), *[F.lit(None).cast("string").alias(c) for c in ("first_ts", "last_ts")])
        counted = rows.groupBy("source").agg(F.count("*").alias("records"), F.min("ts").cast("string").alias("first_ts"), F.max("ts").cast("string").alias("last_ts"))
        return known.join(counted, "source", "left").fillna(0, ["records"])
