"""Pages deep in a sorted view: the range of keys that holds the page is found by counting, and only that is sorted.

A sorted sample of keys tells about where the page is; the two keys around that place
cut the rows into three ranges, one pass counts them, and the counts tell which of them the
page's first and last row fall into.  A range that is still too large is sampled and counted
again.  The sample decides how much is sorted, not what comes out: counts are of all rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from loomlog.functions.fields import resolve
from loomlog.operators.pages import DEFAULT_LIMIT, sort_column

#: Keys sampled in a round, about; rows that are sorted without another round; rounds at most.
SAMPLE, FEW, ROUNDS = 16384, 200_000, 8
#: Standard deviations of a rank in the sample between the page and the keys around it.
SPREAD = 5


def _sent(key: Column, kind: DataType) -> Column:
    """``key`` as a value that means the same to a driver in another time zone, and in an hour that a clock shows twice."""
    if kind.typeName() == "timestamp":
        return F.unix_micros(key)
    return key.cast("string") if kind.typeName() == "timestamp_ntz" else key


def _literal(value, kind: DataType) -> Column:
    """What ``_sent`` made ``value`` of."""
    return F.timestamp_micros(F.lit(value).cast("long")) if kind.typeName() == "timestamp" else F.lit(value).cast(kind)


def _before(keys: list[Column], bound: list, kinds: list, descending: bool, equal: bool) -> Column:
    """Does a row stand before ``bound`` in the page's order, or (``equal``) at it?  Nulls are last either way."""
    cases, same = [], F.lit(True)
    for i, (key, value, kind) in enumerate(zip(keys, bound, kinds, strict=True)):
        at = _literal(value, kind)
        ahead = key.isNotNull() if value is None else F.coalesce(key > at if descending and i == 0 else key < at, F.lit(False))
        cases.append(same & ahead)
        same = same & key.eqNullSafe(at)
    return reduce(or_, [*cases, same] if equal else cases)


def jump_page(view: DataFrame, field: str | None = None, descending: bool = False, limit: int = DEFAULT_LIMIT, offset: int = 0, ties: list[str] = (), few: int = FEW) -> DataFrame:
    """As ``page``: rows offset .. offset + limit by ``field``, nulls last either way, ``ties`` deciding between equals.

    ``ties`` are ascending, as in ``page``.
    """
    keys = [sort_column(view, field), *[resolve(view, t) for t in ties]]
    order = [keys[0].desc_nulls_last() if descending else keys[0].asc_nulls_last(), *[c.asc_nulls_last() for c in keys[1:]]]
    names = [f"k{i}" for i in range(len(keys))]
    kinds = [f.dataType for f in view.select(*[c.alias(n) for c, n in zip(keys, names, strict=True)]).schema]
    in_sample = [F.col("k0").desc_nulls_last() if descending else F.col("k0").asc_nulls_last(), *[F.col(n).asc_nulls_last() for n in names[1:]]]
    rows, skipped, total = view, 0, view.count()
    if offset >= total or limit <= 0:
        return view.limit(0)
    for _ in range(ROUNDS):
        if total <= max(few, limit):
            break
        some = rows.select(*[c.alias(n) for c, n in zip(keys, names, strict=True)]).sample(min(1.0, SAMPLE / total))
        sample = some.repartition(1).sortWithinPartitions(*in_sample).select(*[_sent(F.col(n), k).alias(n) for n, k in zip(names, kinds, strict=True)]).collect()  # about SAMPLE keys
        places = [min(1.0, (n - skipped) / total) for n in (offset, offset + limit)]
        lo, hi = (int(len(sample) * p + way * (1 + SPREAD * (len(sample) * p * (1 - p) + 1) ** 0.5)) for p, way in zip(places, (-1, 1), strict=True))
        first, last = (sample[i] if 0 <= i < len(sample) else None for i in (lo, hi))
        ahead = F.lit(False) if first is None else _before(keys, first, kinds, descending, False)
        upto = F.lit(True) if last is None else _before(keys, last, kinds, descending, True)
        ranges = [ahead, ~ahead & upto, ~ahead & ~upto]
        counts = rows.agg(*[F.count_if(r) for r in ranges]).first()
        starts = [skipped, skipped + counts[0], skipped + counts[0] + counts[1], skipped + total]
        wanted = [i for i in range(3) if starts[i] < offset + limit and starts[i + 1] > offset]
        if len(wanted) == 3 or sum(counts[i] for i in wanted) > 0.9 * total:
            break
        rows, skipped, total = rows.filter(reduce(or_, [ranges[i] for i in wanted])), starts[wanted[0]], sum(counts[i] for i in wanted)
    return rows.orderBy(*order).offset(offset - skipped).limit(limit)
