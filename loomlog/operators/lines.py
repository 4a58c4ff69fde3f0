"""Line logs: regex captures, continuation folding, timestamps with missing dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.fields import named
from loomlog.functions.times import iso, parse_layout
from loomlog.operators.ordered import running_rollovers, running_sum, running_sums
from loomlog.operators.rules import LineRule

TIMESTAMP, FORMAT = "@timestamp", "_source_format"
DAY = 86_400_000_000
#: Bytes of a piece of a record that is folded in pieces.
PIECE_BYTES = 8 << 20


def captures(line: Column, rule: LineRule) -> dict[str, Column]:
    return {g: F.regexp_extract(line, rule.pattern, i + 1) for i, g in enumerate(rule.groups)}


def is_header(line: Column, rule: LineRule) -> Column:
    return line.rlike(rule.pattern)


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def rewritten(ts: Column, rule: LineRule) -> Column:
    """The captured timestamp text after the rule's substitutions, in order."""
    for pattern, replacement in rule.ts_regex_subs:
        ts = F.regexp_replace(ts, pattern, replacement)
    return ts


def time_of_day(ts: Column, rule: LineRule) -> Column:
    """Microseconds since midnight of a timestamp without a date."""
    return F.pmod(F.unix_micros(parse_layout(rewritten(ts, rule), rule.ts_layout)), F.lit(DAY))


def with_year_of(ts: Column, mtime: Column, layout: str) -> Column:
    """A timestamp without a year in the year of ``mtime``, or the year before if it would be over a day ahead.

    29 February becomes 1 March in other years.
    """
    leap = parse_layout(F.concat(F.lit("2000 "), ts), f"2006 {layout}")

    def in_year(year: Column) -> Column:
        made = F.try_make_timestamp(year, F.month(leap), F.dayofmonth(leap), F.hour(leap), F.minute(leap), F.second(leap) + F.pmod(F.unix_micros(leap), F.lit(1_000_000)) / 1_000_000)
        march = F.try_make_timestamp(year, F.lit(3), F.lit(1), F.hour(leap), F.minute(leap), F.second(leap))
        return F.coalesce(made, F.when(leap.isNotNull(), march))

    at = mtime.cast("timestamp")
    this = in_year(F.year(at))
    return F.when(F.unix_micros(this) - F.unix_micros(at) > DAY, in_year(F.year(at) - 1)).otherwise(this)


def parse_records(lines: DataFrame, rule: LineRule) -> DataFrame:
    """Single-line parse of header lines: file, part, seq, captured columns, timestamp, format.

    ``lines``: file, part, seq, value and, for rules that need it, mtime.
    """
    got = captures(F.col("value"), rule)
    rows = lines.filter(is_header(F.col("value"), rule))
    rows = rows.select(*[c for c in lines.columns if c != "value"], *[c.alias(g if g != "ts" else "__ts") for g, c in got.items()])
    return _dated(rows, rule).withColumn(FORMAT, F.lit(f"line:{rule.name}"))


def _dated(rows: DataFrame, rule: LineRule) -> DataFrame:
    text = rewritten(F.col("__ts"), rule)
    if rule.ts_use_mtime_date:
        rows = running_rollovers(rows, time_of_day(F.col("__ts"), rule), "__days")
        day = F.unix_micros(F.date_trunc("day", F.from_utc_timestamp(F.col("mtime").cast("timestamp"), rule.ts_assume_tz)))
        local = F.timestamp_micros(day + F.col("__days") * DAY + time_of_day(F.col("__ts"), rule))
        parsed = local if rule.ts_assume_tz == "UTC" else F.to_utc_timestamp(local, rule.ts_assume_tz)
    elif rule.ts_use_mtime_year:
        local = with_year_of(text, F.from_utc_timestamp(F.col("mtime").cast("timestamp"), rule.ts_assume_tz), rule.ts_layout)
        parsed = local if rule.ts_assume_tz == "UTC" else F.to_utc_timestamp(local, rule.ts_assume_tz)
    else:
        parsed = parse_layout(text, rule.ts_layout, rule.ts_assume_tz)
    return rows.withColumn(TIMESTAMP, iso(parsed)).drop("__ts", "__days")


def fold_records(lines: DataFrame, rule: LineRule) -> DataFrame:
    """Whole records: lines that aren't headers, and aren't blank, continue the message of the one before.

    Lines before a file's first header are dropped.  Returns file, part, seq (of
    the header), captured columns, timestamp, format.
    """
    marked = lines.withColumn("__head", is_header(F.col("value"), rule))
    numbered = running_sum(marked, F.col("__head"), "__rid").filter(F.col("__rid") > 0)
    tail = F.when(~F.col("__head") & ~is_blank(F.col("value")), F.struct("part", "seq", "value"))
    head = F.when(F.col("__head"), F.struct(*[c for c in lines.columns if c != "file"]))
    records = numbered.groupBy("file", "__rid").agg(F.max(head).alias("h"), F.array_sort(F.collect_list(tail)).alias("more"))
    folded = records.select("file", "h.*", F.transform("more", lambda x: x["value"]).alias("__more"))
    got = captures(F.col("value"), rule)
    message = got.get(rule.message_field)
    extra = F.array_join("__more", "\n")
    if message is None:
        body = F.when(F.size("__more") > 0, extra)
    else:
        body = F.when(F.size("__more") > 0, F.concat(message, F.lit("\n"), extra)).otherwise(message)
    columns = {g if g != "ts" else "__ts": c for g, c in got.items()} | {rule.message_field: body}
    rows = folded.select("file", *[c for c in lines.columns if c not in ("file", "value")], *[c.alias(g) for g, c in columns.items()])
    return _dated(rows, rule).withColumn(FORMAT, F.lit(f"line:{rule.name}"))


def fold_in_pieces(lines: DataFrame, rule: LineRule, piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records, pieces) as ``fold_records``, for records of any size.

    records: the header line parsed alone, with n_more (lines that continue it) and
    n_bytes (of them).  pieces: (file, head_part, head_seq, piece, text) of these
    lines, each of ``piece_bytes`` and a line at most; the message of a record is its own,
    and then its pieces in order, with line ends between.

    Lines are dealt by a running sum of bytes, so a record that is most of a file is
    put together by as many tasks as it has pieces, and nothing is joined on it.
    """
    value = F.col("value")
    marked = lines.withColumn("__head", is_header(value, rule))
    size = F.when(~F.col("__head") & ~is_blank(value), F.octet_length(value) + 1).otherwise(0)
    numbered = running_sums(marked, {"__rid": F.col("__head").cast("long"), "__at": size.cast("long")}).filter(F.col("__rid") > 0)
    more = numbered.filter(~F.col("__head") & ~is_blank(value)).withColumn("__piece", F.floor(F.col("__at") / piece_bytes))
    held = more.groupBy("file", "__rid", "__piece").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "value"))).alias("x"), F.count("*").alias("n"), F.sum(F.octet_length(value) + 1).alias("bytes"))
    heads = numbered.filter("__head")
    places = heads.select("file", "__rid", F.col("part").alias("head_part"), F.col("seq").alias("head_seq"))
    texts = held.select("file", "__rid", F.col("__piece").alias("piece"), F.array_join(F.transform("x", lambda x: x["value"]), "\n").alias("text"))
    pieces = texts.join(places, ["file", "__rid"]).select("file", "head_part", "head_seq", "piece", "text")
    sums = held.groupBy("file", "__rid").agg(F.sum("n").alias("n_more"), F.sum("bytes").alias("n_bytes"))
    counted = heads.join(sums, ["file", "__rid"], "left").select(*lines.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_more", "n_bytes")])
    return parse_records(counted, rule), pieces


def choose_rule(lines: DataFrame, rules: tuple[LineRule, ...], sample_lines: int = 200) -> DataFrame:
    """(file, rule): the rule of highest priority that matches one of the first non-blank lines, first in order on ties."""
    some = lines.filter(~is_blank(F.col("value")))
    first = some.groupBy("file").agg(F.min("part").alias("part"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("seq"))
    few = some.join(first, ["file", "part"]).withColumn("__n", nth).filter(F.col("__n") <= sample_lines)  # the first split of a file
    hits = few.select("file", *[is_header(F.col("value"), r).alias(r.name) for r in rules])
    any_hit = hits.groupBy("file").agg(*[F.bool_or(named(r.name)).alias(r.name) for r in rules])
    ranked = sorted(rules, key=lambda r: -r.priority)
    return any_hit.select("file", F.coalesce(*[F.when(named(r.name), F.lit(r.name)) for r in ranked]).alias("rule"))


def audit(lines: DataFrame, rules: tuple[LineRule, ...], source: str = "file") -> DataFrame:
    """(source, rule, lines, parsed, continuation, timestamp_errors): how well each rule parses each source."""
    value = F.col("value")
    entries = []
    for rule in rules:
        head = is_header(value, rule)
        ts = captures(value, rule)["ts"]
        bad = time_of_day(ts, rule).isNull() if rule.ts_use_mtime_date else parse_layout(rewritten(ts, rule), rule.ts_layout).isNull()
        if rule.ts_use_mtime_year:
            bad = parse_layout(F.concat(F.lit("2000 "), ts), f"2006 {rule.ts_layout}").isNull()
        entries.append(F.struct(F.lit(rule.name).alias("rule"), head.alias("head"), (head & bad).alias("bad"), (~head & ~is_blank(value)).alias("more")))
    rows = lines.select(F.col(source).alias("source"), F.explode(F.array(*entries)).alias("x"))
    return rows.groupBy("source", F.col("x.rule").alias("rule")).agg(
        F.count("*").alias("lines"), F.count_if("x.head").alias("parsed"), F.count_if("x.more").alias("continuation"), F.count_if("x.bad").alias("timestamp_errors")
    )
