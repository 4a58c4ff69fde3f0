"""Every operator as a query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog import formats
from loomlog.functions.fields import list_fields, pick_timestamp_field, resolve
from loomlog.functions.times import WIDTHS, present
from loomlog.operators import blocks, detect, event_records, export, heavy, histogram, infer, jump, lines, pages, profile, rules, xmlrows
from loomlog.operators.predicates import Filter, filters, predicate, preset, search
from loomlog.operators.union import source_counts, union_view
from loomlog.plans import renderings as R
from loomlog.plans.renderings import table
from loomlog.sources import loading, sidecars
from loomlog.sources.scans import configure, read_decoded_events, read_heads, read_lines, read_ndjson, read_parquet
from loomlog.sources.source_set import SourceSet
from loomlog.sources.xml_splits import read_xml_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
LINEITEM_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
COLUMNS = {"events": EVENT_COLUMNS, "orders": ORDER_COLUMNS, "lineitem": LINEITEM_COLUMNS}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(configure(spark), sf_dir)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def view(spark: SparkSession, sf_dir: str, *names: str, mode: str = "text") -> DataFrame:
    return union_view({n: table(spark, sf_dir, n) for n in names}, mode)


def union_sql(*names: str) -> str:
    parts = [f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in COLUMNS[n])}, '{n}' AS _source FROM {n}" for n in names]
    return " UNION ALL BY NAME ".join(parts)


# --- union, filters, pages --------------------------------------------------

_ALL = ", ".join(c for n in COLUMNS for c in COLUMNS[n])


@query("union_page", f"SELECT {_ALL} FROM ({union_sql('events', 'orders', 'lineitem')}) WHERE lower(event_type) = 'error' AND TRY_CAST(ts AS TIMESTAMP) BETWEEN '2024-01-03' AND '2024-01-20 12:00:00' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50")
def union_page(spark, sf_dir):
    v = view(spark, sf_dir, "events", "orders", "lineitem")
    rows = v.filter(predicate(v, [Filter("event_type", "is", "Error")], "ts", "2024-01-03 00:00:00", "2024-01-20 12:00:00"))
    return pages.page(rows, "ts", descending=True, limit=50, offset=50, ties=["event_id"]).drop("_source")


@query("union_typed_range", "SELECT event_id, ts, value FROM events WHERE ts BETWEEN '2024-01-05' AND '2024-01-06'")
def union_typed_range(spark, sf_dir):
    v = view(spark, sf_dir, "events", "orders", "lineitem", mode="typed")
    return v.filter(predicate(v, [], "ts", "2024-01-05 00:00:00", "2024-01-06 00:00:00")).select("event_id", "ts", "value")


@query("union_case_merge", "SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE upper(event_type) END AS \"Event_Type\" FROM events UNION ALL SELECT CAST(event_id AS VARCHAR), lower(event_type) FROM events WHERE event_id % 5 = 0")
def union_case_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    both = rows.select("event_id", F.when(even, F.col("event_type")).alias("Event_Type"), F.when(~even, F.upper("event_type")).alias("event_type"))
    other = rows.filter("event_id % 5 = 0").select(F.col("event_id").alias("EVENT_ID"), F.lower("event_type").alias("EVENT_TYPE"))
    return union_view({"a": both, "b": other}).drop("_source")


_FILTERS = {
    "filter_is": (Filter("event_type", "is", "CLICK"), "lower(event_type) = 'click'"),
    "filter_is_not": (Filter("event_type", "is_not", "click"), "lower(event_type) <> 'click'"),
    "filter_contains": (Filter("o_orderpriority", "contains", "urgent"), "o_orderpriority ILIKE '%urgent%'"),
    "filter_not_contains": (Filter("o_orderpriority", "not_contains", "o_"), "o_orderpriority NOT ILIKE '%o_%'"),
    "filter_wildcard": (Filter("o_orderpriority", "wildcard", "*-h*"), "o_orderpriority ILIKE '%-h%'"),
    "filter_not_wildcard": (Filter("event_type", "not_wildcard", "*c*"), "event_type NOT ILIKE '%c%'"),
    "filter_exists": (Filter("event_type", "exists"), "event_type IS NOT NULL AND event_type <> ''"),
    "filter_not_exists": (Filter("event_type", "does_not_exist"), "event_type IS NULL OR event_type = ''"),
    "filter_one_of": (Filter("event_type", "is_one_of", "view, Click ,,"), "lower(event_type) IN ('view', 'click')"),
    "filter_not_one_of": (Filter("event_type", "is_not_one_of", "view,click"), "lower(event_type) NOT IN ('view', 'click') OR event_type IS NULL"),
}
for _name, (_filter, _where) in _FILTERS.items():

    @query(_name, f"SELECT _source, event_id, event_type, o_orderkey, o_orderpriority FROM ({union_sql('events', 'orders')}) WHERE {_where}")
    def _filtered(spark, sf_dir, f=_filter):
        v = view(spark, sf_dir, "events", "orders")
        return v.filter(filters(v, [f])).select("_source", "event_id", "event_type", "o_orderkey", "o_orderpriority")


@query("filter_and_or", "SELECT event_id, event_type, value FROM events WHERE lower(event_type) = 'error' AND CAST(user_id AS VARCHAR) ILIKE '%1%' OR lower(event_type) = 'signup' AND lower(CAST(user_id AS VARCHAR)) <> '7'")
def filter_and_or(spark, sf_dir):
    v = table(spark, sf_dir, "events")
    chain = [Filter("", "is", "x"), Filter("event_type", "is", "error"), Filter("user_id", "contains", "1"), Filter("value", "no such", "1"), Filter("event_type", "is", "signup", "or"), Filter("user_id", "is_not", "7")]
    return v.filter(filters(v, chain)).select("event_id", "event_type", "value")


@query("filter_flat_chain", "SELECT event_id FROM events WHERE ts >= '2024-01-10' AND lower(event_type) = 'view' OR lower(event_type) = 'click' AND (event_type ILIKE '%k%' OR props ILIKE '%k%')")
def filter_flat_chain(spark, sf_dir):
    v = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "props")
    flat = predicate(v, [Filter("event_type", "is", "view"), Filter("event_type", "is", "click", "or")], "ts", "2024-01-10 00:00:00", text="k", strict=False)
    return v.filter(flat).select("event_id")


@query("time_range", "SELECT event_id FROM events WHERE event_id % 4 <> 3 AND CASE WHEN event_id % 4 = 2 THEN date_trunc('second', ts) ELSE ts END BETWEEN '2024-01-07 06:00:00' AND '2024-01-09'")
def time_range(spark, sf_dir):
    text = F.col("ts").cast("string")
    spelled = F.when(F.col("event_id") % 4 == 0, text).when(F.col("event_id") % 4 == 1, F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z"))).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "HH:mm:ss"))
    v = union_view({"events": table(spark, sf_dir, "events").withColumn("ts", spelled)})
    return v.filter(predicate(v, [], "ts", "2024-01-07 06:00:00", "2024-01-09T00:00:00Z")).select(F.col("event_id").cast("long").alias("event_id"))


@query("free_text", "SELECT 'documents' AS _source, doc_id AS id FROM documents WHERE CAST(doc_id AS VARCHAR) ILIKE '%license%' OR text ILIKE '%license%' OR lang ILIKE '%license%' OR source ILIKE '%license%' OR CAST(n_chars AS VARCHAR) ILIKE '%license%' UNION ALL SELECT 'conversations', conv_id FROM conversations WHERE role ILIKE '%license%' OR text ILIKE '%license%'")
def free_text(spark, sf_dir):
    v = view(spark, sf_dir, "documents", "conversations")
    return v.filter(search(v, "License")).select("_source", F.coalesce("doc_id", "conv_id").cast("long").alias("id"))


@query("struct_path_filter", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') ILIKE '%7%'")
def struct_path_filter(spark, sf_dir):
    typed = R.typed_events(spark, sf_dir)
    return typed.filter(filters(typed, [Filter("props.K", "contains", "7")])).select("event_id", F.col("props.k").cast("string").alias("k"))


@query("json_path_filter", "SELECT CAST(event_id AS VARCHAR) AS event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_path_filter(spark, sf_dir):
    v = view(spark, sf_dir, "events", "orders")
    return v.filter(filters(v, [Filter("props.k", "is", "42")])).select("event_id")


@query("sort_desc_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 200 OFFSET 400")
def sort_desc_page(spark, sf_dir):
    return pages.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "O_TotalPrice", descending=True, limit=200, offset=400, ties=["o_orderkey"])


@query("keyset_page", "SELECT o_orderdate, o_orderkey FROM orders WHERE o_orderdate > '1997-01-01' OR o_orderdate = '1997-01-01' AND o_orderkey > 100 ORDER BY o_orderdate, o_orderkey LIMIT 200")
def keyset_page(spark, sf_dir):
    from datetime import datetime

    rows = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return pages.keyset_page(rows, ["o_orderdate", "o_orderkey"], [datetime(1997, 1, 1), 100], 200)


_FILL = " UNION ALL ".join(f"SELECT '{c}' AS field, {i} AS nth, count(CASE WHEN CAST({c} AS VARCHAR) <> '' THEN 1 END) AS filled FROM u" for i, c in enumerate((*EVENT_COLUMNS, *ORDER_COLUMNS)))


@query("column_fill_order", f"WITH u AS ({union_sql('events', 'orders')}), c AS ({_FILL}) SELECT field, filled, CAST(row_number() OVER (ORDER BY CASE WHEN field = 'ts' THEN 0 ELSE 1 END, CASE WHEN field = 'ts' THEN 0 ELSE -filled END, nth) - 1 AS INTEGER) AS place FROM c")
def column_fill_order(spark, sf_dir):
    return pages.column_order(view(spark, sf_dir, "events", "orders"), "ts")


@query("compact_rows", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, NULL AS o_orderkey FROM events UNION ALL SELECT NULL, NULL, CAST(o_orderkey AS VARCHAR) FROM orders")
def compact_rows(spark, sf_dir):
    rows = pages.compact_json(view(spark, sf_dir, "events", "orders"))
    return rows.select(*[F.get_json_object("row", f"$.{c}").alias(c) for c in ("event_id", "event_type", "o_orderkey")])


# --- aggregates ---------------------------------------------------------------


@query("filtered_count", "SELECT count(*) AS n FROM events WHERE lower(event_type) = 'error'")
def filtered_count(spark, sf_dir):
    v = view(spark, sf_dir, "events", "orders", "lineitem")
    return v.filter(filters(v, [Filter("event_type", "is", "error")])).agg(F.count("*").alias("n"))


@query("time_bounds", "SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM events")
def time_bounds(spark, sf_dir):
    return histogram.time_bounds(view(spark, sf_dir, "events", "orders"), "ts")


def _histogram_sql(where: str) -> str:
    ladder = " ".join(f"WHEN s // {w} <= 120 THEN {w}" for w in WIDTHS)
    return (
        f"WITH e AS (SELECT ts FROM events WHERE {where}), span AS (SELECT CAST(floor(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6) AS BIGINT) AS s FROM e), "
        f"w AS (SELECT CASE {ladder} ELSE (s // 120 // 86400 + 1) * 86400 END AS w FROM span) "
        "SELECT time_bucket(to_seconds(w), ts) AS bucket, count(*) AS n FROM e, w GROUP BY 1"
    )


@query("histogram_auto", _histogram_sql("true"))
def histogram_auto(spark, sf_dir):
    return histogram.histogram(view(spark, sf_dir, "events", "orders"), "ts")


@query("histogram_one_pass", _histogram_sql("true"))
def histogram_one_pass(spark, sf_dir):
    return histogram.one_pass_histogram(view(spark, sf_dir, "events", "orders"), "ts")


@query("histogram_filtered", _histogram_sql("event_type = 'click' AND ts BETWEEN '2024-01-10' AND '2024-01-10 06:00:00'"))
def histogram_filtered(spark, sf_dir):
    v = table(spark, sf_dir, "events")
    return histogram.histogram(v.filter(predicate(v, [Filter("event_type", "is", "click")], "ts", "2024-01-10 00:00:00", "2024-01-10 06:00:00")), "ts")


def _profile_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(nullif({c}, '')) AS present, count(DISTINCT nullif({c}, '')) AS \"distinct\", count(DISTINCT CASE WHEN nullif({c}, '') IS NOT NULL THEN _source END) AS sources FROM u" for n in COLUMNS for c in COLUMNS[n]
    )
    return f"WITH u AS ({union_sql('events', 'orders', 'lineitem')}), t AS (SELECT count(*) AS total, count(DISTINCT _source) AS sources_total FROM u) SELECT *, present / total AS fill, false AS truncated FROM ({each}), t"


@query("profile_exact", _profile_sql())
def profile_exact(spark, sf_dir):
    return profile.profile(view(spark, sf_dir, "events", "orders", "lineitem"), exact=True)


@query("profile_approx")
def profile_approx(spark, sf_dir):
    return profile.profile(view(spark, sf_dir, "events", "orders", "lineitem"))


@query("top_values", "SELECT o_orderpriority AS value, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def top_values(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return histogram.with_shares(profile.top_values(view(spark, sf_dir, "events", "orders"), "o_orderpriority", 3), rows.count())


@query("field_samples", "SELECT 'event_type' AS field, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS vals FROM events UNION ALL SELECT 'o_orderstatus', string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) FROM orders UNION ALL SELECT 'o_orderkey', ''")
def field_samples(spark, sf_dir):
    got = profile.field_samples(view(spark, sf_dir, "events", "orders"), ["event_type", "o_orderstatus", "o_orderkey", "no such field"])
    return got.select("field", F.array_join("values", "|").alias("vals"))


@query("source_counts", "SELECT 'events' AS source, count(*) AS records FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def counts(spark, sf_dir):
    return source_counts(view(spark, sf_dir, "events", "orders", "lineitem"))


# --- parsers ------------------------------------------------------------------


def _pick(values: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(v) for v in values)}][event_id % {len(values)} + 1]"


_ISO = "replace(CAST({} AS VARCHAR), ' ', 'T') || 'Z'"
_MS = _ISO.format("date_trunc('millisecond', ts)")
_MESSAGE = "event_type || ' value ' || CAST(value AS VARCHAR) AS message"
_LEVEL, _COMPONENT = f"{_pick(R.LEVELS)} AS level", f"{_pick(R.COMPONENTS)} AS component"
_PID, _TID = "CAST(user_id AS VARCHAR) AS pid", "CAST(event_id % 1000 AS VARCHAR) AS tid"
_LINES = {
    "iso-bracket": f"SELECT event_id, {_LEVEL}, {_COMPONENT}, {_PID}, {_MESSAGE}, {_MS} AS ts, 'line:iso-bracket' AS format FROM events",
    "dashdate-level": f"SELECT event_id, {_LEVEL}, {_MESSAGE}, {_MS} AS ts, 'line:dashdate-level' AS format FROM events",
    "dotdate-pidtid": f"SELECT event_id, 'app.' || {_pick(R.COMPONENTS)} AS source, {_PID}, {_TID}, {_MESSAGE}, {_MS} AS ts, 'line:dotdate-pidtid' AS format FROM events",
    "time-dotdate": f"SELECT event_id, {_MESSAGE}, {_MS} AS ts, 'line:time-dotdate' AS format FROM events",
    "time-pidtid": f"""
WITH t AS (SELECT *, event_id % 4 AS file, epoch_us(ts) % 86400000000 AS tod FROM events),
l AS (SELECT *, CASE WHEN tod + 43200000000 < lag(tod) OVER (PARTITION BY file ORDER BY event_id) THEN 1 ELSE 0 END AS roll FROM t),
d AS (SELECT *, sum(roll) OVER (PARTITION BY file ORDER BY event_id) AS days FROM l)
SELECT event_id, {_PID}, {_TID}, {_LEVEL}, {_MESSAGE}, {_ISO.format("make_timestamp(CAST(epoch_us(TIMESTAMP '2026-03-24') + days * 86400000000 + tod AS BIGINT))")} AS ts, 'line:time-pidtid' AS format FROM d""",
}


def _shown(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("file", "part", "seq", "mtime", "@timestamp", "_source_format")]
    return rows.select(F.col("seq").alias("event_id"), *columns, F.col("`@timestamp`").alias("ts"), F.col("_source_format").alias("format"))


for _rule in rules.LINE_RULES:
    _key = "time_rollover" if _rule.ts_use_mtime_date else f"parse_line_{_rule.name.replace('-', '_')}"

    @query(_key, _LINES[_rule.name])
    def _parsed(spark, sf_dir, rule=_rule):
        return _shown(lines.parse_records(R.event_lines(spark, sf_dir, rule.name), rule))


@query("mtime_year", f"SELECT event_id, 'web1' AS host, event_type AS proc, {_MESSAGE}, {_ISO.format('CASE WHEN x > TIMESTAMP ' + repr(R.YEAR_MTIME) + ' + INTERVAL 1 DAY THEN x - INTERVAL 1 YEAR ELSE x END')} AS ts, 'line:syslog' AS format FROM (SELECT *, date_trunc('second', ts) AS x FROM events)")
def mtime_year(spark, sf_dir):
    return _shown(lines.parse_records(R.event_lines(spark, sf_dir, "syslog", R.YEAR_MTIME), R.SYSLOG))


@query("fold_continuation", r"SELECT doc_id, 'doc ' || doc_id || coalesce(chr(10) || nullif(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), chr(10)), ''), '') AS message FROM documents")
def fold_continuation(spark, sf_dir):
    folded = lines.fold_records(R.document_lines(spark, sf_dir), rules.LINE_RULES[0])
    return folded.select(F.col("pid").cast("long").alias("doc_id"), "message")


_NAMES = "['iso-bracket', 'dashdate-level', 'dotdate-pidtid', 'time-pidtid', 'time-dotdate', 'syslog'][event_id % 6 + 1]"


@query("choose_line_rule", f"SELECT DISTINCT {_NAMES} AS file, nullif({_NAMES}, 'syslog') AS rule FROM events")
def choose_line_rule(spark, sf_dir):
    rows = R.shape_lines(spark, sf_dir).select(F.col("source").alias("file"), F.floor(F.col("line") / 5000).cast("long").alias("part"), F.col("line").alias("seq"), "value")
    return lines.choose_rule(rows, rules.LINE_RULES)


@query("parse_block", r"""SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(turn AS VARCHAR) AS turn, role,
  array_to_string(list_prepend(string_split(text, chr(10))[1], list_transform(list_filter(string_split(text, chr(10))[2:], lambda x: regexp_matches(x, '\S')), lambda x: ' ' || x)), chr(10)) AS text,
  replace(CAST(TIMESTAMP '2024-01-01' + to_minutes(conv_id) AS VARCHAR), ' ', 'T') || 'Z' AS ts, 'block:keyvalue-dash-separated' AS format FROM conversations""")
def parse_block(spark, sf_dir):
    wide = blocks.widen(blocks.parse_blocks(R.block_lines(spark, sf_dir), rules.BLOCK_RULES[0]), ["Conv", "Turn", "Role", "Text"])
    return wide.select(F.col("Conv").alias("conv"), F.col("Turn").alias("turn"), F.col("Role").alias("role"), F.col("Text").alias("text"), F.col("`@timestamp`").alias("ts"), F.col("_source_format").alias("format"))


@query("parse_xml_rows", f"SELECT event_id AS id, event_type AS type, CAST(user_id AS VARCHAR) AS \"user\", CAST(value AS VARCHAR) AS value, 'x' AS unit, '<b> & more' AS detail, array_to_string(list_transform(range(1, event_id % 3 + 2), lambda i: 't' || i), ',') AS tags, {_ISO.format("date_trunc('second', ts)")} AS ts, 'xml:Event' AS format FROM events")
def parse_xml_rows(spark, sf_dir):
    rows = xmlrows.parse_xml_rows(R.xml_rows(spark, sf_dir), "Event")
    return rows.select(
        F.col("Id").cast("long").alias("id"), F.col("`@type`").alias("type"), F.col("User").alias("user"), F.col("Value").alias("value"), F.col("`Value.@unit`").alias("unit"),
        F.col("Detail").alias("detail"), F.array_join("`Info.Tag`", ",").alias("tags"), F.col("`@timestamp`").alias("ts"), F.col("_source_format").alias("format"),
    )


@query("xml_row_element", "SELECT event_id // 200 AS file, 'Event' AS row, count(*) AS siblings, CAST(1 AS BIGINT) AS depth FROM events GROUP BY 1 HAVING count(*) >= 3")
def xml_row_element(spark, sf_dir):
    return xmlrows.row_elements(R.xml_heads(spark, sf_dir))


_TAGS = ", ".join(["event_type AS tag0", *[f"CASE WHEN event_id % 6 >= {i} THEN '{c}' END AS tag{i}" for i, c in enumerate("vwxyz", 1)]])


@query("event_flatten", f"SELECT event_id AS id, 'Security' AS channel, user_id AS \"user\", {_TAGS}, value AS amount, {_ISO.format('CASE WHEN event_id % 11 = 0 THEN TIMESTAMP ' + repr(R.MTIME) + ' ELSE ts END')} AS ts, 'evtx' AS format FROM events")
def event_flatten(spark, sf_dir):
    """Records with lists of one to six items."""
    flat = event_records.flatten_events(R.nested_events(spark, sf_dir), "Event.System.TimeCreated.SystemTime")
    names = {"Event.System.EventID.Value": "id", "Event.System.Channel": "channel", "Event.EventData.User": "user", **{f"Event.EventData.Tags.{i}": f"tag{i}" for i in range(6)}, "Event.EventData.Amount": "amount", "@timestamp": "ts", "_source_format": "format"}
    return flat.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])


@query("preamble_drop", f"SELECT event_id, {_MESSAGE.replace(' AS message', '')} || CASE WHEN event_id % 40 < 4 THEN chr(10) || '  at ' || event_type ELSE '' END AS message FROM events WHERE event_id >= 40")
def preamble_drop(spark, sf_dir):
    """Files that begin with lines of no record, which are dropped; some records have a line more."""
    rows = R.event_lines(spark, sf_dir, "iso-bracket")
    head = rows.withColumn("value", F.when(F.col("seq") < 40, F.concat(F.lit("banner "), "value")).otherwise(F.col("value")))
    more = rows.filter("seq % 40 < 4").withColumn("value", F.regexp_replace("value", r"^.*\] (\S+) value .*$", "  at $1")).withColumn("seq", F.col("seq") + 0.5)
    lines_ = head.withColumn("seq", F.col("seq").cast("double")).unionByName(more)
    return lines.fold_records(lines_, rules.LINE_RULES[0]).select(F.col("seq").cast("long").alias("event_id"), "message")


@query("scan_blocks", """SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(turn AS VARCHAR) AS turn, role FROM conversations""")
def scan_blocks(spark, sf_dir):
    """Block records written to files as lines, and read from them in order."""
    path = _shared(spark, "blocks.log")
    R.block_lines(spark, sf_dir).repartition("file").sortWithinPartitions("file", "seq").select("value").write.text(path)
    wide = blocks.widen(blocks.parse_blocks(read_lines(spark, path), rules.BLOCK_RULES[0]), ["Conv", "Turn", "Role"])
    return wide.select(F.col("Conv").alias("conv"), F.col("Turn").alias("turn"), F.col("Role").alias("role"))


@query("timestamp_override", "SELECT count(*) AS n, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_ts FROM orders WHERE o_orderdate >= '1996-06-01'")
def timestamp_override(spark, sf_dir):
    """A time range by another field than the one that would be picked."""
    sources = SourceSet(spark).add("orders", table(spark, sf_dir, "orders").withColumn("ts", F.lit("2024-01-01 00:00:00"))).add("events", table(spark, sf_dir, "events"))
    picked, sources.timestamp_field = sources.timestamp_field, "o_orderdate"
    v = sources.view("typed")
    found = v.filter(predicate(v, [], sources.timestamp_field, "1996-06-01 00:00:00", "2030-01-01 00:00:00")).filter(F.lit(picked == "ts"))
    return found.agg(F.count("*").alias("n"), F.min(F.substring(F.col("o_orderdate").cast("string"), 1, 10)).alias("first_ts"))


# --- detection, audit, inference ---------------------------------------------

_KIND = "doc_id % 8"
_EXT = f"CASE {_KIND} WHEN 0 THEN '.ndjson' WHEN 2 THEN '.json' ELSE '.log' END"
_PREFIX = f"CASE {_KIND} WHEN 1 THEN '{{{{' WHEN 2 THEN '{{{{' WHEN 3 THEN '<Log>' WHEN 4 THEN repeat('-', 40) || chr(10) || 'Text: ' WHEN 5 THEN '2024-01-01 00:00:00.000 [INF] [DOC] [PID:' || doc_id || '] ' WHEN 6 THEN 'PAR1' ELSE '' END"
_FILES = f"SELECT '/land/d' || doc_id || {_EXT} AS path, {_KIND} AS kind, coalesce(text, '') AS t FROM documents"
_ADAPTER = "['ndjson', 'ndjson', 'ndjson', 'xml', 'block', 'line', 'parquet', NULL][kind + 1]"
_SCORE = "[90, 90, 70, 80, 70, 100, 100, 0][kind + 1]"


@query("classify_files", rf"""SELECT path, {_ADAPTER} AS adapter, {_SCORE} AS score, CASE WHEN kind IN (0, 7) AND t = '' THEN 'empty file,no non-blank line' WHEN kind IN (0, 7) AND NOT regexp_matches(t, '\S') THEN 'no non-blank line' ELSE '' END AS notes,
  CASE kind WHEN 4 THEN repeat('-', 40) ELSE NULL END AS first_line FROM ({_FILES})""")
def classify_files(spark, sf_dir):
    got = detect.classify_files(R.file_heads(spark, sf_dir))
    block = F.pmod(F.regexp_extract("path", r"d(\d+)", 1).cast("long"), F.lit(8)) == 4
    return got.select("path", "adapter", "score", F.array_join("notes", ",").alias("notes"), F.when(block, F.col("first_line")).alias("first_line"))


@query("registered_format", f"SELECT path, CASE WHEN kind = 7 AND t <> '' AND strlen(t) % 2 = 0 THEN 'even' ELSE {_ADAPTER} END AS adapter FROM ({_FILES})")
def registered_format(spark, sf_dir):
    """A format that a user adds: files of an even number of bytes that no built-in format fits."""
    even = formats.Format("even", F.when((F.length("head") > 0) & (F.length("head") % 2 == 0), 1).otherwise(0), lambda session, paths: session.read.text(paths))
    return formats.classify(R.file_heads(spark, sf_dir), [even]).select("path", "adapter")


@query("diagnose", f"""WITH s AS (SELECT path, kind, t, a.adapter, CASE WHEN a.adapter = coalesce({_ADAPTER}, '') THEN {_SCORE} ELSE 0 END AS score
  FROM ({_FILES}), (VALUES ('ndjson'), ('parquet'), ('evtx'), ('block'), ('xml'), ('line')) AS a(adapter)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY score DESC, adapter) AS INTEGER) AS rank FROM s)
SELECT path, adapter, score, rank, rank = 1 AND score > 0 AS chosen, CASE
  WHEN adapter = 'ndjson' THEN CASE WHEN kind = 0 THEN 'extension .ndjson' WHEN kind IN (1, 2) THEN 'first line is a JSON object' WHEN kind = 7 AND NOT regexp_matches(t, '\\S') THEN 'file is empty' ELSE 'first character is not an opening brace' END
  WHEN adapter = 'parquet' THEN CASE WHEN kind = 6 THEN 'starts with the Parquet signature' ELSE 'no Parquet signature or extension' END
  WHEN adapter = 'evtx' THEN 'no event log signature'
  WHEN adapter = 'block' THEN CASE WHEN kind = 4 THEN 'sniff pattern of keyvalue-dash-separated matches' ELSE 'no sniff pattern matches' END
  WHEN adapter = 'xml' THEN CASE WHEN kind = 3 THEN 'sniff pattern of repeating-row-element matches' ELSE 'no sniff pattern matches' END
  ELSE CASE WHEN kind = 5 THEN 'line pattern of iso-bracket matches' ELSE 'no line pattern matches' END END AS reason FROM r""")
def diagnose(spark, sf_dir):
    return detect.diagnose(R.file_heads(spark, sf_dir)).select("path", "adapter", "score", "rank", "chosen", "reason")


@query("parse_audit", """WITH l AS (SELECT 'app' || event_id % 4 AS source, CASE WHEN event_id % 23 = 0 THEN 'blank' WHEN event_id % 29 = 0 THEN 'more' WHEN event_id % 17 = 0 THEN 'bad' ELSE 'good' END AS k FROM events)
SELECT source, 'iso-bracket' AS rule, count(*) AS lines, count(*) FILTER (k IN ('good', 'bad')) AS parsed, count(*) FILTER (k = 'more') AS continuation, count(*) FILTER (k = 'bad') AS timestamp_errors FROM l GROUP BY 1
UNION ALL SELECT source, r, count(*), 0, count(*) FILTER (k <> 'blank'), 0 FROM l, (VALUES ('dashdate-level'), ('dotdate-pidtid'), ('time-pidtid'), ('time-dotdate')) AS t(r) GROUP BY 1, 2""")
def parse_audit(spark, sf_dir):
    return lines.audit(R.mixed_lines(spark, sf_dir), rules.LINE_RULES, "source")


def _value_sql() -> str:
    ms, m = "strftime(ts, '{}.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0')", "event_type || ' value ' || CAST(value AS VARCHAR)"
    level, part, us = _pick(R.LEVELS), _pick(R.COMPONENTS), "lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0')"
    milli = "lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0')"
    return f"""CASE event_id % 6
  WHEN 0 THEN {ms.format('%Y-%m-%d %H:%M:%S')} || ' [' || {level} || '] [' || {part} || '] [PID:' || user_id || '] ' || {m}
  WHEN 1 THEN {ms.format('%d-%m-%Y %H:%M:%S')} || ' ' || {level} || '    ' || {m}
  WHEN 2 THEN 'app.' || {part} || ': ' || strftime(ts, '%d.%m.%y %H:%M:%S:') || {milli} || ' ' || user_id || '/' || event_id % 1000 || ' ' || {m}
  WHEN 3 THEN strftime(ts, '%H:%M:%S.') || {us} || ' ' || user_id || '/' || event_id % 1000 || ' ' || {level} || '   ' || {m}
  WHEN 4 THEN strftime(ts, '%H:%M:%S.') || {milli} || strftime(ts, ' %d.%m.%Y: ') || {m}
  ELSE strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S web1 ') || event_type || ': ' || {m} END"""


_LINE_TABLE = f"line AS (SELECT {_NAMES} AS source, event_id AS line, {_value_sql()} AS value FROM events)"
_SHAPE_COUNTS = ", ".join(f"count(*) FILTER (regexp_matches(value, '{p}')) AS \"{n}\"" for n, p in infer.SHAPES)
_SHAPE_LADDER = " ".join(f"WHEN \"{n}\" >= ceil(lines / 2) THEN '{n}'" for n, _ in infer.SHAPES)
_SHAPE_TABLE = f"{_LINE_TABLE}, counted AS (SELECT source, count(*) AS lines, {_SHAPE_COUNTS} FROM line GROUP BY 1), shapes AS (SELECT source, lines, CASE {_SHAPE_LADDER} END AS shape FROM counted)"


@query("infer_ts_shape", f"WITH {_SHAPE_TABLE} SELECT source, lines, shape FROM shapes")
def infer_ts_shape(spark, sf_dir):
    return infer.timestamp_shapes(R.shape_lines(spark, sf_dir))


@query("infer_date_order", f"WITH {_LINE_TABLE}, d AS (SELECT source, CAST(day(ts) AS INTEGER) AS a, CAST(month(ts) AS INTEGER) AS b FROM line JOIN events ON line = event_id WHERE source IN ('dashdate-level', 'dotdate-pidtid', 'time-dotdate')) SELECT source, max(a) AS first_max, max(b) AS second_max, CASE WHEN max(a) > 12 THEN 'day-first' WHEN max(b) > 12 THEN 'month-first' ELSE 'day-first' END AS \"order\", (max(a) > 12) = (max(b) > 12) AS ambiguous FROM d WHERE source <> 'time-dotdate' GROUP BY source")
def infer_date_order(spark, sf_dir):
    rows = R.shape_lines(spark, sf_dir)
    return infer.date_orders(rows, infer.timestamp_shapes(rows))


_KINDS = "CASE WHEN regexp_full_match(text, '{shape}') THEN 'timestamp' WHEN text[1] IN (' ', chr(9)) THEN 'space' WHEN regexp_matches(text, '^\\p{{Nd}}') THEN 'number' WHEN lower(text) IN ({levels}) THEN 'level' WHEN regexp_matches(text, '^[\\p{{L}}_]') THEN 'word' ELSE 'punct' END"


def _tokens_sql() -> str:
    shapes = dict(infer.SHAPES)
    levels = ", ".join(f"'{x}'" for x in infer.LEVELS)
    per_shape = " UNION ALL ".join(
        f"SELECT source, line, unnest(range(len(t))) AS pos, unnest(t) AS text, '{n}' AS shape FROM (SELECT source, line, regexp_extract_all(value, '{p}|[ \\t]+|\\p{{Nd}}+|[\\p{{L}}_][\\p{{L}}\\p{{Nd}}_]*|.')[:40] AS t FROM line JOIN shapes USING (source) WHERE shape = '{n}')"
        for n, p in shapes.items()
    )
    kinds = " ".join(f"WHEN shape = '{n}' THEN {_KINDS.format(shape=p, levels=levels)}" for n, p in shapes.items())
    counted = ", ".join(f"count(*) FILTER (kind = '{k}') AS \"{k}\"" for k in ("timestamp", "space", "number", "level", "word", "punct"))
    return f"WITH {_SHAPE_TABLE}, tok AS ({per_shape}), kinded AS (SELECT *, CASE {kinds} END AS kind FROM tok) SELECT source, CAST(pos AS INTEGER) AS pos, count(*) AS lines, {counted}, min(text) AS least, max(text) AS greatest FROM kinded GROUP BY source, pos"


@query("token_positions", _tokens_sql())
def token_positions(spark, sf_dir):
    rows = R.shape_lines(spark, sf_dir)
    return infer.token_positions(rows, infer.timestamp_shapes(rows))


#: What is inferred from ``shape_lines``: source, shape, the pattern after its beginning, layout, warnings.
_TEMPLATES = (
    ("iso-bracket", "iso", "^", r"\s+\[(?P<level>[A-Za-z]+)\]\s+\[(?P<field1>[^\s\]]+)\]\s+\[PID\:(?P<pid>\d+)\]\s+", "2006-01-02 15:04:05", ""),
    ("dashdate-level", "dmy-dash", "^", r"\s+(?P<level>[A-Za-z]+)\s+", "02-01-2006 15:04:05", ""),
    ("dotdate-pidtid", "dmy-dot", r"^app\.(?P<field1>[^\s\:]+)\:\s+", r"\s+(?P<field2>\d+)\/(?P<field3>\d+)\s+", "02.01.06 15:04:05", ""),
    ("time-pidtid", "time-only", "^", r"\s+(?P<field1>\d+)\/(?P<field2>\d+)\s+(?P<level>[A-Za-z]+)\s+", "15:04:05", "no date"),
    ("time-dotdate", "time-only", "^", r"\s+(?P<field1>[\d.]+)\:\s+", "15:04:05", "no date"),
    ("syslog", "syslog", "^", r"\s+", "Jan _2 15:04:05", "no year"),
)


def _templates_sql() -> str:
    rows = ", ".join(f"('{n}', '{shape}', '{before}(?P<ts>{dict(infer.SHAPES)[shape]}){after}(?P<message>.*)$', 'line', '{layout}', '{warning}')" for n, shape, before, after, layout, warning in _TEMPLATES)
    return f"WITH {_SHAPE_TABLE} SELECT t.* FROM (VALUES {rows}) AS t(source, shape, pattern, aligned_on, ts_layout, warnings) JOIN shapes ON shapes.source = t.source AND shapes.shape = t.shape"


@query("infer_templates", _templates_sql())
def infer_templates(spark, sf_dir):
    return infer.templates(R.shape_lines(spark, sf_dir)).select("source", "shape", "pattern", "aligned_on", "ts_layout", F.array_join("warnings", ",").alias("warnings"))


@query("zoned_lines_parse", f"SELECT event_id, ['utc', 'colon', 'plain'][CAST(event_id % 3 AS INT) + 1] AS source, {_LEVEL}, {_MESSAGE}, {_MS} AS ts, CASE event_id % 3 WHEN 0 THEN 'Z07:00' WHEN 1 THEN 'Z07:00' ELSE 'Z0700' END AS zone FROM events")
def zoned_lines_parse(spark, sf_dir):
    """Timestamps with three spellings of a zone: each source's rule inferred, and its lines parsed by it."""
    rows = R.zoned_lines(spark, sf_dir)
    out = None
    for name, rule in infer.line_rules(infer.templates(rows)).items():
        got = lines.parse_records(rows.filter(F.col("source") == name), rule)
        got = got.select(F.col("line").alias("event_id"), "source", "level", "message", F.col("`@timestamp`").alias("ts"), F.lit(rule.ts_layout.split("05")[-1]).alias("zone"))
        out = got if out is None else out.unionByName(got)
    return out


@query("inferred_rules_parse", f"""WITH l AS (SELECT {_NAMES} AS source, day(ts) AS d, ts FROM events)
SELECT source, count(*) AS lines, count(*) AS parsed, 0 AS timestamp_errors, min(CASE source WHEN 'iso-bracket' THEN '2006-01-02 15:04:05' WHEN 'dashdate-level' THEN '02-01-2006 15:04:05' WHEN 'dotdate-pidtid' THEN '02.01.06 15:04:05' WHEN 'syslog' THEN 'Jan _2 15:04:05' ELSE '15:04:05' END) AS ts_layout FROM l GROUP BY source""")
def inferred_rules_parse(spark, sf_dir):
    """Each source's inferred rule on the source's own lines."""
    rows = R.shape_lines(spark, sf_dir)
    ready = infer.line_rules(infer.templates(rows))
    layouts = spark.createDataFrame([(n, r.ts_layout) for n, r in ready.items()], "rule string, ts_layout string")
    return lines.audit(rows, tuple(ready.values()), "source").filter("source = rule").join(F.broadcast(layouts), "rule").select("source", "lines", "parsed", "timestamp_errors", "ts_layout")  # one row a source


_PRIORITIES = ", ".join(f"('{r.name}', {r.priority})" for r in rules.LINE_RULES)


@query("rule_inventory_audit", f"""SELECT 'app' || event_id % 4 AS source, r.name AS rule, 'line' AS family, r.priority, count(*) FILTER (r.name = 'iso-bracket' AND event_id % 23 <> 0 AND event_id % 29 <> 0) / count(*) AS parsed_share
  FROM events, (VALUES {_PRIORITIES}) AS r(name, priority) GROUP BY ALL""")
def rule_inventory_audit(spark, sf_dir):
    audited = lines.audit(R.mixed_lines(spark, sf_dir), rules.LINE_RULES, "source")
    return audited.join(F.broadcast(rules.inventory(spark)), audited["rule"] == F.col("name")).select("source", "rule", "family", "priority", (F.col("parsed") / F.col("lines")).alias("parsed_share"))  # one row a rule


# --- sinks and scans ------------------------------------------------------------


def _shared(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{name.replace('.', f'-{uuid.uuid4().hex}.')}"


def _exported(spark: SparkSession, sf_dir: str, suffix: str) -> str:
    """events and orders as text, exported into the shared folder."""
    path = _shared(spark, f"export{suffix}")
    export.export(view(spark, sf_dir, "events", "orders"), path, "ts")
    return path


_EXPORTED = f"SELECT event_id, ts, event_type, value, o_orderkey, o_orderdate FROM ({union_sql('events', 'orders')})"


@query("export_parquet_roundtrip", _EXPORTED)
def export_parquet_roundtrip(spark, sf_dir):
    return read_parquet(spark, _exported(spark, sf_dir, ".parquet")).select("event_id", "ts", "event_type", "value", "o_orderkey", "o_orderdate")


@query("export_ndjson_roundtrip", _EXPORTED)
def export_ndjson_roundtrip(spark, sf_dir):
    schema = ", ".join(f"{c} string" for c in (*EVENT_COLUMNS, *ORDER_COLUMNS))
    return read_ndjson(spark, _exported(spark, sf_dir, ".ndjson"), schema).select("event_id", "ts", "event_type", "value", "o_orderkey", "o_orderdate")


@query("scan_lines", f"SELECT event_id, {_LEVEL}, {_COMPONENT}, {_PID}, {_MESSAGE}, {_MS} AS ts FROM events WHERE event_id % 5 <> 0")
def scan_lines(spark, sf_dir):
    """Lines written to files and read again; every fifth is overlong and dropped whole."""
    path = _shared(spark, "lines.log")
    text = F.concat(R.line_text("iso-bracket"), F.when(F.col("event_id") % 5 == 0, F.repeat(F.lit("x"), 400)).otherwise(F.lit("")), F.lit(" #"), F.col("event_id").cast("string"))
    table(spark, sf_dir, "events").select(text).write.text(path)
    got = lines.parse_records(read_lines(spark, path, max_bytes=300), rules.LINE_RULES[0])
    return got.select(F.regexp_extract("message", r"#(\d+)$", 1).cast("long").alias("event_id"), "level", "component", "pid", F.regexp_replace("message", r" #\d+$", "").alias("message"), F.col("`@timestamp`").alias("ts"))


@query("scan_xml_rows", "SELECT event_id AS id, event_type AS type, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS \"user\" FROM events")
def scan_xml_rows(spark, sf_dir):
    """Row elements written to files without a root and read again; every third has no content."""
    path = _shared(spark, "rows.xml")
    head = F.concat(F.lit('<Event id="'), F.col("event_id").cast("string"), F.lit('" type="'), "event_type", F.lit('"'))
    body = F.when(F.col("event_id") % 3 == 0, F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit("><User>"), F.col("user_id").cast("string"), F.lit("</User></Event>")))
    table(spark, sf_dir, "events").select(body).write.text(path)
    got = xmlrows.parse_xml_rows(read_xml_rows(spark, path, "Event"), "Event")
    return got.select(F.col("`@id`").cast("long").alias("id"), F.col("`@type`").alias("type"), F.col("User").alias("user"))


@query("scan_decoded_events", "SELECT event_id AS id, event_type AS type FROM events WHERE event_id % 7 <> 0")
def scan_decoded_events(spark, sf_dir):
    """Decoded event records written as lines of JSON, every seventh of them cut short."""
    path = _shared(spark, "records.json")
    text = F.to_json(F.struct(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")).alias("E")))
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)).write.text(path)
    return read_decoded_events(spark, path, "E struct<id: long, type: string>")[0].select("E.id", "E.type")


_LINE_BYTES = "40 + strlen(['CS', 'DB', 'NET', 'UI'][CAST(event_id % 4 AS INT) + 1]) + strlen(CAST(user_id AS VARCHAR)) + strlen(event_type || ' value ' || CAST(value AS VARCHAR)) + 1"


@query("file_heads", f"""SELECT CASE WHEN event_id % 2 = 0 THEN 'line' ELSE 'ndjson' END AS adapter, CAST(sum(CASE WHEN event_id % 2 = 0 THEN {_LINE_BYTES}
  ELSE strlen('{{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}') + 1 END) AS BIGINT) AS bytes, CAST(512 AS BIGINT) AS head_bytes FROM events GROUP BY 1""")
def file_heads(spark, sf_dir):
    """The first 512 bytes of longer files of two kinds, told apart by them."""
    path = _shared(spark, "landing.d")
    rows = table(spark, sf_dir, "events").coalesce(1)
    json = F.to_json(F.struct("event_id", "event_type"))
    for kind, text in enumerate((R.line_text("iso-bracket"), json)):
        rows.filter(F.col("event_id") % 2 == kind).select(text).write.text(f"{path}/{kind}")
    heads = read_heads(spark, path, 512)
    found = detect.classify_files(heads).join(heads.select("path", "size", F.length("head").alias("n")), "path")
    return found.groupBy("adapter").agg(F.sum("size").alias("bytes"), F.min("n").cast("long").alias("head_bytes"))


@query("load_report", """SELECT CAST(user_id % 5 AS BIGINT) AS part, count(*) AS n_lines, count(*) FILTER (event_id % 10 = 3 AND event_id > 100 AND user_id % 5 < 2) AS n_bad,
  CASE WHEN count(*) FILTER (event_id % 10 = 3 AND event_id > 100 AND user_id % 5 < 2) = 0 THEN sum(event_id) END AS loaded_ids FROM events GROUP BY 1""")
def load_report(spark, sf_dir):
    """NDJSON files, some with lines cut short: what is reported of the bad ones, and what the others load."""
    path = _shared(spark, "landing.d")
    text = F.to_json(F.struct("event_id", "event_type"))
    broken = (F.col("event_id") % 10 == 3) & (F.col("event_id") > 100) & (F.col("user_id") % 5 < 2)  # no file begins with one
    rows = table(spark, sf_dir, "events").select(F.when(broken, F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text).alias("value"), (F.col("user_id") % 5).alias("part"), "event_id")
    rows.repartition(5, "part").sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part").text(path)
    loaded, problems = loading.load_files(spark, path)
    part = lambda c: F.regexp_extract(c, r"/part=(\d+)/", 1).cast("long").alias("part")
    counts = [F.regexp_extract("reason", r"^(\d+) of (\d+) lines", i).cast("long") for i in (2, 1)]
    bad = problems.select(part("path"), counts[0].alias("n_lines"), counts[1].alias("n_bad"), F.lit(None).cast("long").alias("loaded_ids"))
    good = loaded["ndjson"].groupBy(part("file")).agg(F.count("*").alias("n_lines"), F.lit(0).cast("long").alias("n_bad"), F.sum("event_id").alias("loaded_ids"))
    return bad.unionByName(good)


@query("heavy_words", r"""SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS value FROM documents) GROUP BY value ORDER BY n DESC, value LIMIT 50""")
def heavy_words(spark, sf_dir):
    """The most frequent words of all documents, without a shuffle of all words."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    return heavy.heavy_hitters(words, "word", 50)


@query("heavy_uniform", "SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def heavy_uniform(spark, sf_dir):
    """A field of values about as frequent as each other, in which summaries of 64 values prove nothing."""
    return heavy.heavy_hitters(table(spark, sf_dir, "lineitem"), "l_partkey", 20, held=64)


def _deep_sql(table_: str, order: str, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS nth, count(*) OVER () AS total FROM {table_}) WHERE nth > total * 9 // 10 AND nth <= total * 9 // 10 + 100"


@query("deep_page", _deep_sql("lineitem", "l_extendedprice, l_orderkey, l_linenumber", "l_orderkey, l_linenumber, l_extendedprice"))
def deep_page(spark, sf_dir):
    """A hundred rows at nine tenths of a sorted table: ranges are counted, one is sorted."""
    rows = table(spark, sf_dir, "lineitem")
    return jump.jump_page(rows, "l_extendedprice", limit=100, offset=rows.count() * 9 // 10, ties=["l_orderkey", "l_linenumber"], few=2000).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("deep_page_descending", _deep_sql("events", "ts DESC NULLS LAST, event_id", "event_id, event_type"))
def deep_page_descending(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return jump.jump_page(rows, "ts", True, 100, rows.count() * 9 // 10, ["event_id"], few=1000).select("event_id", "event_type")


@query("fold_in_pieces", """SELECT doc_id, count(*) - 1 AS n_more, sum(strlen(l) + 1) - min(CASE WHEN nth = 1 THEN strlen(l) + 1 END) AS n_bytes, sha256(string_agg(l, chr(10) ORDER BY nth) FILTER (nth > 1)) AS text_sha256
  FROM (SELECT doc_id, l, nth FROM (SELECT doc_id, unnest(list_prepend('head', string_split(coalesce(text, ''), chr(10)))) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 2)) AS nth FROM documents) WHERE nth = 1 OR regexp_matches(l, '\\S')) GROUP BY doc_id""")
def fold_in_pieces(spark, sf_dir):
    """Documents' lines behind a header line each, folded in pieces of 500 bytes and put together for comparison."""
    records, pieces = lines.fold_in_pieces(R.document_lines(spark, sf_dir), rules.LINE_RULES[0], 500)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "\n")
    joined = pieces.groupBy("file", F.col("head_seq").alias("seq")).agg(F.sha2(text, 256).alias("text_sha256"))
    return records.join(joined, ["file", "seq"], "left").select(F.col("pid").cast("long").alias("doc_id"), "n_more", "n_bytes", "text_sha256")


def _indexed(spark: SparkSession, sf_dir: str, name: str, key: str) -> sidecars.Index:
    """A table written as eight files by ranges of its key, and their index."""
    path, at = _shared(spark, f"{name}.files"), _shared(spark, f"{name}.index")
    table(spark, sf_dir, name).repartitionByRange(8, key).write.parquet(path)
    return sidecars.refresh(spark, [path], at)


@query("indexed_search", "SELECT doc_id FROM documents WHERE CAST(doc_id AS VARCHAR) ILIKE '%license%' OR text ILIKE '%license%' OR lang ILIKE '%license%' OR source ILIKE '%license%' OR CAST(n_chars AS VARCHAR) ILIKE '%license%'")
def indexed_search(spark, sf_dir):
    """Free text by way of the files' trigram bitmaps."""
    return sidecars.search_files(spark, _indexed(spark, sf_dir, "documents", "doc_id"), "License").select("doc_id")


@query("kept_profile", """SELECT field, CAST(present AS BIGINT) AS present, true AS distinct_within_bound, CAST(total AS BIGINT) AS total, first_ts, last_ts FROM (
  SELECT 'event_id' AS field, count(event_id) AS present, count(*) AS total, NULL AS first_ts, NULL AS last_ts FROM events UNION ALL
  SELECT 'ts', count(ts), count(*), CAST(min(ts) AS VARCHAR), CAST(max(ts) AS VARCHAR) FROM events UNION ALL SELECT 'user_id', count(user_id), count(*), NULL, NULL FROM events UNION ALL
  SELECT 'event_type', count(nullif(event_type, '')), count(*), NULL, NULL FROM events UNION ALL SELECT 'value', count(value), count(*), NULL, NULL FROM events UNION ALL SELECT 'props', count(nullif(props, '')), count(*), NULL, NULL FROM events)""")
def kept_profile(spark, sf_dir):
    """Filled values, times and distinct values from the index alone; the sketch against the exact count, within 5 %."""
    index = _indexed(spark, sf_dir, "events", "event_id")
    rows = table(spark, sf_dir, "events")
    exact = profile.profile(rows, exact=True).select("field", F.col("distinct").alias("exactly"))
    close = (F.abs(F.col("distinct") - F.col("exactly")) <= F.greatest(F.lit(1), 0.05 * F.col("exactly"))).alias("distinct_within_bound")
    out = sidecars.profile(index).join(exact, "field").join(sidecars.bounds(index), "field", "left")
    return out.select("field", "present", close, "total", F.col("first_ts").cast("string").alias("first_ts"), F.col("last_ts").cast("string").alias("last_ts"))


# --- sources and fields ---------------------------------------------------------


@query("source_listing", "SELECT 'events' AS source, true AS enabled, count(*) AS records, CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts FROM events UNION ALL SELECT 'orders', false, count(*), CAST(CAST(min(o_orderdate) AS TIMESTAMP) AS VARCHAR), CAST(CAST(max(o_orderdate) AS TIMESTAMP) AS VARCHAR) FROM orders UNION ALL SELECT 'region', true, count(*), NULL, NULL FROM region")
def source_listing(spark, sf_dir):
    sources = _sources(spark, sf_dir)
    return sources.listing().filter("bytes > 0 AND path LIKE 'file:%' OR path LIKE '%:/%'").select("source", "enabled", "records", "first_ts", "last_ts")


def _sources(spark: SparkSession, sf_dir: str) -> SourceSet:
    sources = SourceSet(spark)
    for name in ("events", "orders", "region", "nation"):
        sources.add(name, table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet")
    try:
        sources.add("again", table(spark, sf_dir, "events"), f"{sf_dir}/../{sf_dir.rstrip('/').rsplit('/', 1)[1]}/events.parquet")
    except ValueError:
        pass  # the same path twice
    return sources.drop("nation").enable("orders", False)


@query("fields_declared", "SELECT lower(column_name) AS field, count(*) AS sources FROM (DESCRIBE events) GROUP BY 1 UNION ALL SELECT lower(column_name), count(*) FROM (DESCRIBE region) GROUP BY 1")
def fields_declared(spark, sf_dir):
    found = _sources(spark, sf_dir).files_declaring()
    return spark.createDataFrame([(k, n) for k, n in found.items() if k != "_source"], "field string, sources long")


@query("enabled_sources", "SELECT 'events' AS source, count(*) AS records FROM events UNION ALL SELECT 'region', count(*) FROM region")
def enabled_sources(spark, sf_dir):
    return source_counts(_sources(spark, sf_dir).view()).select("source", "records")


@query("timestamp_field", "SELECT event_id, CAST(ts AS VARCHAR) AS picked, CAST(user_id AS VARCHAR) AS k FROM events")
def timestamp_field(spark, sf_dir):
    """The field that is picked for the timestamp, a field by its struct path, and columns left out."""
    rows = R.typed_events(spark, sf_dir).withColumn("who", F.struct(F.col("user_id").alias("Id")))
    shown = pages.visible(rows, ["value", "event_type", "user_id"])
    known = list_fields(shown)
    return shown.select("event_id", resolve(shown, pick_timestamp_field(known)).cast("string").alias("picked"), resolve(shown, next(f for f in known if f.lower() == "who.id")).cast("string").alias("k"))


@query("time_presets", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def time_presets(spark, sf_dir):
    from datetime import datetime

    rows = table(spark, sf_dir, "events")
    return rows.filter(predicate(rows, [], "ts", *preset("24h", datetime(2024, 1, 20, 12)))).select("event_id")


@query("rules_from_mapping", f"SELECT event_id, {_MESSAGE}, {_MS} AS ts, 'line:mine' AS format FROM events")
def rules_from_mapping(spark, sf_dir):
    """A rule that is only data: checked, then parsed by."""
    mine, _ = rules.load_rules({"20-mine": {"family": "line", "name": "mine", "parse": r"^(?P<ts>\S+ \S+) \w{3} +(?P<message>.*)$", "ts_layout": "02-01-2006 15:04:05.000"}, "30-odd": {"family": "nothing"}})
    return _shown(lines.parse_records(R.event_lines(spark, sf_dir, "dashdate-level"), mine[0])).select("event_id", "message", "ts", "format")


@query("present_timestamps", "SELECT event_id, strftime(ts + CASE WHEN ts >= TIMESTAMP '2024-03-31 01:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S.%g') AS berlin FROM events")
def present_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", present(F.col("ts"), "Europe/Berlin").alias("berlin"))
