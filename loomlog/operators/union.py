"""Union of sources whose schemas differ, aligned by case-folded column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.fields import SOURCE, as_text, canonical_names, named


def union_view(sources: dict[str, DataFrame], mode: str = "text") -> DataFrame:
    """All rows of all sources under canonical names, with ``_source``.

    ``text``: every value in its text form.  ``typed``: a column keeps its type
    where all sources that have it agree, and is text elsewhere; filters on such
    columns reach each source's scan.  Missing columns are null.  Columns of one
    source that fold to one name are coalesced in order.
    """
    if not sources:
        raise ValueError("no source is enabled")
    names = canonical_names([df.columns for df in sources.values()])
    kinds: dict[str, set] = {n.lower(): set() for n in names}
    for df in sources.values():
        for field in df.schema:
            kinds[field.name.lower()].add(field.dataType)
    parts = []
    for label, df in sources.items():
        columns = []
        for name in names:
            keeps = mode == "typed" and len(kinds[name.lower()]) == 1
            mine = [f for f in df.schema if f.name.lower() == name.lower()]
            values = [named(f.name) if keeps else as_text(named(f.name), f.dataType) for f in mine]
            missing = F.lit(None).cast(next(iter(kinds[name.lower()])) if keeps else "string")
            columns.append((F.coalesce(*values) if len(values) > 1 else values[0] if values else missing).alias(name))
        parts.append(df.select(*columns, F.lit(label).alias(SOURCE)))
    return reduce(DataFrame.unionByName, parts)


def without_provenance(view: DataFrame) -> DataFrame:
    return view.drop(SOURCE)


def source_counts(view: DataFrame, *more: str) -> DataFrame:
    """Records of each source (and of each value of ``more``, such as a source format)."""
    return view.groupBy(F.col(SOURCE).alias("source"), *more).agg(F.count("*").alias("records"))
