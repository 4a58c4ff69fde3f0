"""Line templates inferred per source: which timestamp, which fields, which pattern.

All lines are looked at in two passes, for the shapes and for the positions of tokens.
The second one sums up: a task keeps, for each source, one array of counters
(token position, from the line's beginning and from its timestamp, by kind of token;
least and greatest text; how timestamps are written) and hands over its few rows,
which are added up by source.  No token becomes a row.  Patterns are written
from the sums in columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomlog.operators.rules import LineRule, validate

MAX_TOKENS, MAX_CAPTURES = 40, 8

# Timestamp shapes, the more special ones first, and words for levels.
SHAPES = (
    ("iso", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"),
    ("iso-slash", r"\d{4}/\d{2}/\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"),
    ("clf", r"\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}"),
    ("dmy-dash", r"\d{2}-\d{2}-\d{4}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"),
    ("dmy-dot", r"\d{2}\.\d{2}\.\d{2,4}[ T]\d{2}:\d{2}:\d{2}(?:[.:,]\d+)?"),
    ("syslog", r"\b[A-Z][a-z]{2} [ 0-9]\d \d{2}:\d{2}:\d{2}\b"),
    ("time-only", r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"),
)
LEVELS = (
    "trace debug dbg info inf notice warn warning wrn error err fatal crit critical severe verbose fine finer finest panic alert emerg"
).split()

_TOKEN = r"[ \t]+|\p{Nd}+|[\p{L}_][\p{L}\p{Nd}_]*|[^\n\r\x85\u2028\u2029]"
KINDS = ("timestamp", "space", "number", "level", "word", "punct")


def timestamp_shapes(lines: DataFrame) -> DataFrame:
    """(source, lines, shape): the first shape that half the lines of a source have, null if none."""
    counted = lines.groupBy("source").agg(F.count("*").alias("lines"), *[F.count_if(F.col("value").rlike(p)).alias(n) for n, p in SHAPES])
    need = F.ceil(F.col("lines") / 2)
    return counted.select("source", "lines", F.coalesce(*[F.when(F.col(f"`{n}`") >= need, F.lit(n)) for n, _ in SHAPES]).alias("shape"))


def matched(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """Lines with the shape of their source and the text ``ts`` it matches, '' where it doesn't."""
    held = lines.join(shapes.select("source", "shape"), "source")
    ts = F.coalesce(*[F.when(F.col("shape") == n, F.regexp_extract("value", f"({p})", 1)) for n, p in SHAPES], F.lit(""))
    return held.withColumn("ts", ts)


def _day_parts(ts: Column) -> tuple[Column, Column]:
    """The two-digit parts that a date of unknown order begins with; null where there are none."""
    return tuple(F.when(F.col("shape").isin("dmy-dash", "dmy-dot"), F.regexp_extract(ts, r"^(\d{2})[-.](\d{2})", i).try_cast("int")) for i in (1, 2))


def _order(first_max: Column, second_max: Column) -> tuple[Column, Column]:
    order = F.when(first_max > 12, F.lit("day-first")).when(second_max > 12, F.lit("month-first")).otherwise(F.lit("day-first"))
    return order.alias("order"), ((first_max > 12) == (second_max > 12)).alias("ambiguous")


def _zone(ts: Column) -> Column:
    return F.when(ts.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.lit("Z07:00")).when(ts.rlike(r"\d{2}[+-]\d{4}$"), F.lit("Z0700")).otherwise(F.lit(""))


def date_orders(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """(source, first_max, second_max, order, ambiguous) for sources whose dates begin with two two-digit parts."""
    first, second = _day_parts(F.col("ts"))
    parts = matched(lines, shapes).filter(F.col("shape").isin("dmy-dash", "dmy-dot")).select("source", first.alias("a"), second.alias("b"))
    most = parts.groupBy("source").agg(F.max("a").alias("first_max"), F.max("b").alias("second_max"))
    return most.select("*", *_order(F.col("first_max"), F.col("second_max")))


def zone_suffixes(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """(source, zone): '', 'Z07:00' or 'Z0700', whichever most timestamps of a source carry."""
    votes = matched(lines, shapes).filter("ts <> ''").groupBy("source", _zone(F.col("ts")).alias("zone")).agg(F.count("*").alias("n"))
    return votes.groupBy("source").agg(F.max_by("zone", F.struct("n", "zone")).alias("zone"))


# --- summaries ------------------------------------------------------------------

#: How timestamps are written: votes of a source.
STAMP_VOTES = ("between_t", "short", "colon", "zone_colon", "zone_plain")
SUMMARY = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("way", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("lines", T.LongType())]
    + [T.StructField(k, T.LongType()) for k in (*KINDS, *STAMP_VOTES)]
    + [T.StructField(c, T.StringType()) for c in ("least", "greatest")]
    + [T.StructField(c, T.IntegerType()) for c in ("most0", "most1")]
)
#: Different orders of kinds that a task remembers of a source before it adds them up.
REMEMBERED = 5000


class _Source:
    """The sums of one source in one task."""

    def __init__(self, shape: str):
        self.stamp = regex.compile(dict(SHAPES)[shape], regex.ASCII).search
        self.dated = shape in ("dmy-dash", "dmy-dot")
        self.orders: Counter = Counter()  # (kinds of a line's tokens, place of the timestamp): lines
        self.counts = {w: [[0] * len(KINDS) for _ in range(MAX_TOKENS)] for w in ("line", "timestamp")}
        self.texts: dict[int, list] = {}  # place of the timestamp: least and greatest text of each position
        self.forms: Counter = Counter()  # timestamps with their digits made 0, which votes don't look at: lines
        self.votes, self.most, self.stamped = [0] * len(STAMP_VOTES), [None, None], 0

    def add(self, value: str, kinds: dict[str, int]) -> None:
        found = self.stamp(value)
        if found:
            lo, hi = found.span()
            before = _SPLIT(value[:lo])[:MAX_TOKENS] if lo else []
            words, at = (before + [value[lo:hi], *_SPLIT(value[hi:])])[:MAX_TOKENS], len(before)
            self._stamp(value[lo:hi])
        else:
            words, at = _SPLIT(value)[:MAX_TOKENS], MAX_TOKENS
        order = [kinds[w] if w in kinds else _kind(w, kinds) for w in words]
        if at < len(order):
            order[at] = 0
        self.orders[bytes(order), at] += 1
        if len(self.orders) > REMEMBERED:
            self._settle()
        texts = self.texts.get(at)
        if texts is None:
            texts = self.texts[at] = [None] * MAX_TOKENS
        for i, w in enumerate(words):
            held = texts[i]
            if held is None:
                texts[i] = (w, w)
            elif w < held[0]:
                texts[i] = (w, held[1])
            elif w > held[1]:
                texts[i] = (held[0], w)

    def _stamp(self, ts: str) -> None:
        self.stamped += 1
        self.forms[ts.translate(_ZEROS)] += 1
        if len(self.forms) > REMEMBERED:
            self._settle()
        if self.dated:
            for i, at in enumerate((0, 3)):
                if (part := ts[at : at + 2]).isascii() and part.isdigit():
                    self.most[i] = max(self.most[i] or 0, int(part))

    def _settle(self) -> None:
        for (order, at), n in self.orders.items():
            for way, kinds in (("line", order), ("timestamp", order[at:])):
                counts = self.counts[way]
                for i, k in enumerate(kinds):
                    counts[i][k] += n
        self.orders.clear()
        for form, n in self.forms.items():
            for i, rule in enumerate(_VOTES):
                self.votes[i] += n * (rule(form) is not None)
        self.forms.clear()

    def _texts(self, way: str) -> list:
        """Least and greatest text of each position, from the line's beginning or from the timestamp."""
        out = [None] * MAX_TOKENS
        for at, texts in self.texts.items():
            for i, held in enumerate(texts if way == "line" else texts[at:]):
                if held is not None:
                    out[i] = held if out[i] is None else (min(held[0], out[i][0]), max(held[1], out[i][1]))
        return out

    def rows(self, source: str) -> Iterator[tuple]:
        self._settle()
        none = [0] * len(STAMP_VOTES)
        for way, counts in self.counts.items():
            for pos, (by_kind, texts) in enumerate(zip(counts, self._texts(way), strict=True)):
                if texts is not None:
                    yield source, way, pos, sum(by_kind), *by_kind, *none, *texts, None, None
        yield source, "stamp", -1, self.stamped, *[0] * len(KINDS), *self.votes, None, None, *self.most


_ZEROS = str.maketrans("123456789", "0" * 9)
_SPLIT = regex.compile(_TOKEN).findall
_VOTES = [regex.compile(p, regex.ASCII).search for p in (r"^[\d./-]{8,10}T", r"^\d{2}\.\d{2}\.\d{2}[T ]", r"\d{2}:\d{2}:\d{2}:\d+$", r"(Z|[+-]\d{2}:\d{2})$", r"\d{2}[+-]\d{4}$")]
_LETTER, _DIGIT = regex.compile(r"[\p{L}_]").match, regex.compile(r"\p{Nd}").match


def _kind(word: str, known: dict[str, int]) -> int:
    kind = 1 if word[0] in " \t" else 2 if _DIGIT(word) else 3 if word.lower() in LEVELS else 4 if _LETTER(word) else 5
    if len(known) < 100_000:
        known[word] = kind
    return kind


def summaries(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """Sums of ``lines`` (source, value) by (source, way, pos): SUMMARY.

    way line: positions from a line's beginning; timestamp: from its timestamp, lines
    without one left out; stamp (one row): how timestamps are written and, in most0 and
    most1, the greatest of the two parts that a date of unknown order begins with.
    Sources without a shape are left out.
    """
    held = lines.join(shapes.filter("shape IS NOT NULL").select("source", "shape"), "source").select("source", "shape", F.col("value").cast("string"))
    arrow = to_arrow_schema(SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, kinds = {}, {}
        for batch in batches:
            for source, shape, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if source not in sources:
                    sources[source] = _Source(shape)
                if value is not None:
                    sources[source].add(value, kinds)
        rows = [row for name, source in sources.items() for row in source.rows(name)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    sums = [F.sum(c).alias(c) for c in ("lines", *KINDS, *STAMP_VOTES)]
    most = [F.min("least").alias("least"), *[F.max(c).alias(c) for c in ("greatest", "most0", "most1")]]
    return held.mapInArrow(run, SUMMARY).groupBy("source", "way", "pos").agg(*sums, *most)


def _positions(summed: DataFrame, way: str) -> DataFrame:
    return summed.filter(F.col("way") == way).select("source", "pos", "lines", *KINDS, "least", "greatest")


def token_positions(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """(source, pos, lines, count of each kind, least and greatest text), at most MAX_TOKENS positions of a source."""
    return _positions(summaries(lines, shapes), "line")


def aligned_positions(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """As ``token_positions``, counted from each line's timestamp; lines without one are left out."""
    return _positions(summaries(lines, shapes), "timestamp")


# --- patterns -------------------------------------------------------------------
#
# Positions of a source become pieces of a pattern in columns: each position gets an
# action, the first position that has none ends the pattern, captures are named by
# what stands before them, and the pieces are joined.  At most MAX_TOKENS positions
# of a source and alignment are put in order together.


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\p{L}\p{Nd}\s_])", r"\\$1")


def _actions(positions: DataFrame) -> DataFrame:
    """``positions`` of (source, way) with kind, fixed (the one text all lines have) and action:
    stamp, gap, level, number, join (inside a dotted number), word, text, or null."""
    place = Window.partitionBy("source", "way").orderBy("pos")
    whole = F.col("lines") == F.max("lines").over(Window.partitionBy("source", "way"))
    agreed = F.coalesce(*[F.when(F.col(k) == F.col("lines"), F.lit(k)) for k in ("timestamp", "space", "number", "punct")])
    words = F.when(F.col("level") + F.col("word") == F.col("lines"), F.when(2 * F.col("level") >= F.col("lines"), F.lit("level")).otherwise(F.lit("word")))
    rows = positions.withColumn("kind", F.when(whole, F.coalesce(agreed, words))).withColumn("fixed", F.when(F.col("least") == F.col("greatest"), F.col("least")))
    near = {f"{c}{n:+d}": F.lag(c, -n).over(place) for c in ("kind", "fixed") for n in (-2, -1, 1, 2)}
    rows = rows.withColumns(near)
    kind, fixed = F.col("kind"), F.col("fixed")
    dotted = lambda before, dot, after: (before == "number") & (dot == ".") & (after == "number")
    inside = (kind == "punct") & dotted(F.col("kind-1"), fixed, F.col("kind+1")) | dotted(F.col("kind-2"), F.col("fixed-1"), kind)
    closed = (F.col("kind+1") == "punct") & F.col("fixed+1").isNotNull()
    action = (
        F.when(inside, F.lit("join"))
        .when(kind == "timestamp", F.lit("stamp"))
        .when(kind == "space", F.lit("gap"))
        .when(kind.isin("level", "number"), kind)
        .when((kind == "word") & closed, F.when(fixed.isNotNull(), F.lit("text")).otherwise(F.lit("word")))
        .when((kind == "punct") & fixed.isNotNull(), F.lit("text"))
    )
    return rows.withColumn("action", action).withColumn("run", dotted(kind, F.col("fixed+1"), F.col("kind+2")))


def patterns(positions: DataFrame, shapes: DataFrame) -> DataFrame:
    """(source, way, pattern) from ``positions`` (as ``token_positions`` gives, with way: line or timestamp).

    Numbers, levels and blanks are never literal; a word is literal only where
    all lines have it and the same punctuation closes it, a capture where they
    differ but it is closed; elsewhere the message begins, and also at the
    capture after MAX_CAPTURES or at a second timestamp.  No pattern comes out
    where the message would begin before the timestamp.
    """
    place = Window.partitionBy("source", "way").orderBy("pos")
    upto = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _actions(positions)
    captured = F.col("action").isin("level", "number", "word")
    many = F.count_if(captured).over(upto) > MAX_CAPTURES
    again = (F.col("action") == "stamp") & (F.count_if(F.col("action") == "stamp").over(upto) > 1)
    stops = F.coalesce(F.col("action").isNull() | captured & many | again, F.lit(True))
    rows = rows.withColumn("ended", F.max(stops.cast("int")).over(upto)).filter("ended = 0").drop("ended")

    labelled = F.col("fixed-1").isin(":", "=") & F.col("kind-2").isin("word", "level") & F.col("fixed-2").isNotNull() & (F.col("action") != "level")
    slug = F.trim(F.regexp_replace(F.lower("fixed-2"), "[^a-z0-9]+", "_"), F.lit("_"))
    base = F.when(F.col("action") == "level", F.lit("level")).when(labelled & slug.rlike("^[a-z]"), slug)
    rows = rows.withColumn("base", F.when(captured, base)).withColumn("unnamed", F.count_if(captured & F.col("base").isNull()).over(upto))
    rows = rows.withColumn("base", F.coalesce("base", F.when(captured, F.concat(F.lit("field"), F.col("unnamed").cast("string")))))
    nth = F.row_number().over(Window.partitionBy("source", "way", "base").orderBy("pos")) + F.col("base").isin("ts", "message").cast("int")
    name = F.when(nth == 1, F.col("base")).otherwise(F.concat("base", F.lit("__"), nth.cast("string")))  # no other name has two underscores

    shape = F.coalesce(*[F.when(F.col("shape") == n, F.lit(p)) for n, p in SHAPES])
    action = F.col("action")
    body = F.when(action == "level", F.lit("[A-Za-z]+")).when(action == "word", F.concat(F.lit(r"[^\s"), _escaped(F.col("fixed+1")), F.lit("]+"))).when(F.col("run"), F.lit(r"[\d.]+")).otherwise(F.lit(r"\d+"))
    piece = (
        F.when(action == "stamp", F.concat(F.lit("(?P<ts>"), shape, F.lit(")")))
        .when(action == "gap", F.lit(r"\s+"))
        .when(action == "text", _escaped(F.col("fixed")))
        .when(action == "join", F.lit(""))
        .otherwise(F.concat(F.lit("(?P<"), name, F.lit(">"), body, F.lit(")")))
    )
    pieces = rows.join(F.broadcast(shapes.select("source", "shape")), "source").withColumn("piece", piece)  # one row a source
    joined = pieces.groupBy("source", "way").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("x"), F.bool_or(action == "stamp").alias("dated"))
    start = F.when(F.col("way") == "line", F.lit("^")).otherwise(F.lit("^.*?"))
    return joined.filter("dated").select("source", "way", F.concat(start, F.array_join(F.transform("x", lambda x: x["piece"]), ""), F.lit("(?P<message>.*)$")).alias("pattern"))


def stamp_facts(summed: DataFrame, shapes: DataFrame) -> DataFrame:
    """(source, ts_layout, ts_regex_subs, ts_use_mtime_date, ts_use_mtime_year, ambiguous): how a source's timestamps read.

    What stands between date and time, the digits of the year, a colon before the
    fraction and the zone are what most timestamps of the source have; day or
    month first is told by the parts over 12.  ``summed``: as ``summaries`` gives.
    """
    mostly = lambda c: 2 * F.col(c) > F.col("lines")
    plain = F.col("lines") - F.col("zone_colon") - F.col("zone_plain")
    zone = F.when((plain >= F.col("zone_colon")) & (plain >= F.col("zone_plain")), F.lit("")).when(F.col("zone_plain") >= F.col("zone_colon"), F.lit("Z0700")).otherwise(F.lit("Z07:00"))
    facts = summed.filter("way = 'stamp' AND lines > 0").join(shapes.select("source", "shape"), "source").select(
        "source", "shape", F.when(mostly("between_t"), F.lit("T")).otherwise(F.lit(" ")).alias("between"), mostly("short").alias("short"), mostly("colon").alias("colon"),
        zone.alias("zone"), *_order(F.col("most0"), F.col("most1")),
    )
    first = F.when(F.col("order") == "month-first", F.lit("01")).otherwise(F.lit("02"))
    second = F.when(F.col("order") == "month-first", F.lit("02")).otherwise(F.lit("01"))
    time = F.lit("15:04:05")
    layout = (
        F.when(F.col("shape") == "iso", F.concat(F.lit("2006-01-02"), "between", time, "zone"))
        .when(F.col("shape") == "iso-slash", F.concat(F.lit("2006/01/02"), "between", time))
        .when(F.col("shape") == "clf", F.lit("02/Jan/2006:15:04:05 -0700"))
        .when(F.col("shape") == "dmy-dash", F.concat(first, F.lit("-"), second, F.lit("-2006"), "between", time))
        .when(F.col("shape") == "dmy-dot", F.concat(first, F.lit("."), second, F.when(F.col("short"), F.lit(".06")).otherwise(F.lit(".2006")), "between", time))
        .when(F.col("shape") == "syslog", F.lit("Jan _2 15:04:05"))
        .otherwise(time)
    )
    sub = F.array(F.struct(F.lit(r"(\d{2}:\d{2}:\d{2}):(\d+)$").alias("pattern"), F.lit("$1.$2").alias("replacement")))
    none = F.array().cast("array<struct<pattern:string,replacement:string>>")
    return facts.select(
        "source", layout.alias("ts_layout"), F.when((F.col("shape") == "dmy-dot") & F.col("colon"), sub).otherwise(none).alias("ts_regex_subs"),
        (F.col("shape") == "time-only").alias("ts_use_mtime_date"), (F.col("shape") == "syslog").alias("ts_use_mtime_year"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
    )


def templates(lines: DataFrame) -> DataFrame:
    """One inferred line rule a source: source, shape, pattern, aligned_on, the columns of ``stamp_facts`` and warnings.

    aligned_on: line (positions from the line's beginning agree), timestamp (the
    text before it is skipped), or none (only the timestamp could be placed).
    warnings, in this order: ``no date`` and ``no year`` (taken from the file), ``day or month
    first``, ``prefix skipped``, ``fields not told apart``.  Sources in which half the
    lines have no timestamp are left out.  The sums, at most 81 rows a source, come to the driver.
    """
    spark, shapes = lines.sparkSession, timestamp_shapes(lines).filter("shape IS NOT NULL")
    shapes = spark.createDataFrame(shapes.collect(), shapes.schema)
    summed = summaries(lines, shapes)
    summed = spark.createDataFrame(summed.collect(), summed.schema)
    both = summed.filter("way <> 'stamp'")
    written = patterns(both, shapes).groupBy("source").agg(*[F.max(F.when(F.col("way") == w, F.col("pattern"))).alias(w) for w in ("line", "timestamp")])
    bare = F.concat(F.lit("^.*?(?P<ts>"), F.coalesce(*[F.when(F.col("shape") == n, F.lit(p)) for n, p in SHAPES]), F.lit(r")\s*(?P<message>.*)$"))
    way = F.when(F.col("line").isNotNull(), F.lit("line")).when(F.col("timestamp").isNotNull(), F.lit("timestamp")).otherwise(F.lit("none"))
    out = shapes.join(written, "source", "left").select("source", "shape", F.coalesce("line", "timestamp", bare).alias("pattern"), way.alias("aligned_on"))
    warnings = (("no date", F.col("ts_use_mtime_date")), ("no year", F.col("ts_use_mtime_year")), ("day or month first", F.col("ambiguous")), ("prefix skipped", F.col("aligned_on") != "line"), ("fields not told apart", F.col("aligned_on") == "none"))
    return out.join(stamp_facts(summed, shapes), "source").withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(w)) for w, c in warnings])))


def line_rules(found: DataFrame, priority: int = 50) -> dict[str, LineRule]:
    """A checked rule for each source of ``templates``, named after it (one row a source comes to the driver)."""
    out = {}
    for r in found.collect():
        subs = tuple((s["pattern"], s["replacement"]) for s in r["ts_regex_subs"])
        rule = LineRule(r["source"], r["pattern"], r["ts_layout"], priority, ts_regex_subs=subs, ts_use_mtime_date=r["ts_use_mtime_date"], ts_use_mtime_year=r["ts_use_mtime_year"])
        validate(rule)
        out[r["source"]] = rule
    return out
