import json

import pytest
from loomlog import formats
from loomlog.functions.times import WIDTHS, parse_layout, pick_width, present, spark_pattern
from loomlog.operators import blocks, detect, event_records, histogram, infer, lines, rules, xmlrows
from loomlog.operators.export import export, stage
from loomlog.operators.ordered import with_parts
from loomlog.operators.predicates import predicate
from loomlog.operators.union import union_view
from loomlog.sources import scans
from loomlog.sources.xml_splits import read_xml_rows
from loomlog.streaming import tail
from pyspark.sql import functions as F

BY_NAME = {r.name: r for r in rules.ALL_RULES}


def frame(spark, texts, mtime="2026-03-24 10:00:00", per_part=2):
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, seq long, value string")
    return with_parts(df.withColumn("mtime", F.lit(mtime).cast("timestamp")), per_part)


def stamps(df):
    return [r["@timestamp"] for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("per_part", [1, 2, 3, 100])
def test_rollover_at_midnight(spark, per_part):
    texts = [f"{t} 1/2 Info   m" for t in ("23:59:58.0", "23:59:59.5")] + ["99:99:99.9 1/2 Info   m"] + [f"{t} 1/2 Info   m" for t in ("00:00:01.0", "00:00:02.0")]
    got = stamps(lines.parse_records(frame(spark, texts, per_part=per_part), BY_NAME["time-pidtid"]))
    assert got == ["2026-03-24T23:59:58Z", "2026-03-24T23:59:59.5Z", None, "2026-03-25T00:00:01Z", "2026-03-25T00:00:02Z"]


def test_year_from_file_time(spark):
    rule = rules.LineRule("syslog", r"^(?P<ts>[A-Z][a-z]{2} [ 0-9]\d \d{2}:\d{2}:\d{2}) (?P<message>.*)$", "Jan _2 15:04:05", ts_use_mtime_year=True)
    texts = ["Mar 18 06:00:00 a", "Dec 31 23:59:59 b", "Jan  2 00:00:01 c", "Feb 29 01:00:00 d"]
    assert stamps(lines.parse_records(frame(spark, texts, "2025-01-02 00:00:00"), rule)) == ["2024-03-18T06:00:00Z", "2024-12-31T23:59:59Z", "2025-01-02T00:00:01Z", "2024-02-29T01:00:00Z"]
    assert stamps(lines.parse_records(frame(spark, texts[3:], "2025-06-01 00:00:00"), rule)) == ["2025-03-01T01:00:00Z"]


def test_layouts(spark):
    assert spark_pattern("02.01.06 15:04:05.000").startswith("dd.MM.yy HH:mm:ss[")
    cases = [("2006-01-02T15:04:05Z07:00", "2024-03-18T06:00:00.25+01:00", "2024-03-18 05:00:00.25"), ("02/Jan/2006:15:04:05 -0700", "18/Mar/2024:06:00:00 +0200", "2024-03-18 04:00:00"), ("2006-01-02 15:04:05", "2024-03-18 06:00:00,5", "2024-03-18 06:00:00.5"), ("2006-01-02", "2024-02-31", None)]
    for layout, text, want in cases:
        assert spark.range(1).select(parse_layout(F.lit(text), layout).cast("string")).first()[0] == want
    zoned = spark.range(1).select(parse_layout(F.lit("2024-07-01 12:00:00"), "2006-01-02 15:04:05", "Europe/Berlin").cast("string")).first()[0]
    assert zoned == "2024-07-01 10:00:00"


@pytest.mark.parametrize("split", ["200", "10000000"])
def test_folding_of_files_is_the_same_for_any_split(spark, tmp_path, split):
    head = "2024-03-18 06:00:{:02d}.123 [INF] [CS] [PID:{}] message {}"
    text = ["preamble", ""]
    for i in range(40):
        text.append(head.format(i, i, i))
        text += ["  at one", "", "\tat two"] if i % 3 == 0 else []
    (tmp_path / "a.log").write_bytes("﻿".encode() + "\r\n".join(text).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = lines.fold_records(scans.read_lines(spark, str(tmp_path)), BY_NAME["iso-bracket"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {int(r.pid): r.message for r in got} == {i: f"message {i}" + ("\n  at one\n\tat two" if i % 3 == 0 else "") for i in range(40)}
    assert {r["@timestamp"] for r in got} == {f"2024-03-18T06:00:{i:02d}.123Z" for i in range(40)}


def test_overlong_lines_are_dropped_and_counted(spark, tmp_path):
    (tmp_path / "a.log").write_text("short\n" + "x" * 100 + "\nlast")
    assert [r.value for r in scans.read_lines(spark, str(tmp_path), 50).collect()] == ["short", "last"]
    assert [r.n_overlong for r in scans.count_overlong(spark, str(tmp_path), 50).collect()] == [1]


def test_blocks(spark):
    dash = "-" * 25
    texts = ["noise: before", dash, "orphan text", "Message: one", "  more", "", "and: not a key?", "ID: 1", "ID: 2", dash, dash, "Timestamp: 2024-03-18T06:00:00+01:00", "Process Name: p x", dash]
    got = blocks.parse_blocks(frame(spark, texts, per_part=3), BY_NAME["keyvalue-dash-separated"]).orderBy("rid").collect()
    assert [dict(r.fields) for r in got] == [{"Message": "one\n  more", "and": "not a key?", "ID": "2"}, {"Timestamp": "2024-03-18T06:00:00+01:00", "Process Name": "p x"}]
    assert [r["@timestamp"] for r in got] == [None, "2024-03-18T05:00:00Z"] and got[0]["_source_format"] == "block:keyvalue-dash-separated"
    wide = blocks.widen(blocks.parse_blocks(frame(spark, texts), BY_NAME["keyvalue-dash-separated"]))
    assert wide.columns[:2] == ["file", "rid"] and "Process Name" in wide.columns


def test_xml_rows_of_rootless_files(spark, tmp_path):
    row = '<Event type="{t}" time="2024-03-18 06:00:0{i}Z"><V unit="s"> {i} </V><Detail>&lt;x a="1"/&gt;</Detail><L><T>a</T><T>b</T></L><Empty> </Empty></Event>'
    (tmp_path / "a.xml").write_text("\n".join(row.format(t="k", i=i) for i in range(5)) + "\n")
    got = xmlrows.parse_xml_rows(read_xml_rows(spark, str(tmp_path), "Event"), "Event")
    r = got.orderBy("`@time`").first()
    assert got.count() == 5 and (r["@type"], r["V"], r["V.@unit"], r["Detail"], r["L.T"], r["Empty"]) == ("k", "0", "s", '<x a="1"/>', ["a", "b"], None)
    assert (r["@timestamp"], r["_source_format"]) == ("2024-03-18T06:00:00Z", "xml:Event")


def test_xml_rows_without_content(spark, tmp_path):
    """Self-closing rows, alone, before others and at the end; slashes and signs in attributes; repeated nested elements."""
    (tmp_path / "a.xml").write_text("<L><E a='1'/><E a='2' b='x/>y'/>\n<E a='3'>t<V k='p'> 1 </V><V><W>q</W></V><V k='r'>2</V></E><EE/><E/><E a='4'><V>z</V></E><E a='5' /></L>")
    (tmp_path / "b.xml").write_text('<E a="6"/>')
    got = xmlrows.parse_xml_rows(read_xml_rows(spark, str(tmp_path), "E"), "E")
    rows = {r["@a"]: r for r in got.collect()}
    assert got.count() == 7 and set(rows) == {"1", "2", "3", None, "4", "5", "6"} and rows["2"]["@b"] == "x/>y"
    assert (rows["3"]["V"], rows["3"]["V.@k"], rows["3"]["V.W"]) == (["1", "2"], ["p", "r"], ["q"]) and rows["4"]["V"] == ["z"]


def test_damaged_records_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"t": 1.5, "n": {"k": 1}}\n{"t": broken\n{"t": 2.5}\n')
    rows, damaged = scans.read_decoded_events(spark, str(tmp_path / "a.json"), "t double, n struct<k: long>")
    assert sorted(r.t for r in rows.collect()) == [1.5, 2.5] and [(r.n_damaged, r.n_read) for r in damaged.collect()] == [(1, 2)]
    flat = event_records.flatten_events(rows.drop("file"), "t")
    assert flat.filter("t = 1.5").first()["n.k"] == 1
    (tmp_path / "b.json").write_text("nothing\n")
    with pytest.raises(ValueError):
        scans.read_decoded_events(spark, str(tmp_path / "b.json"), "t double")


def test_bad_files_are_reported(spark, tmp_path):
    for name, body in {"a.parquet": b"PAR1xPAR1", "b.parquet": b"junk", "c.ndjson": b"\xef\xbb\xbf\n {}", "d.ndjson": b"[1]", "e.log": b"a\x00b", "f.log": b"plain"}.items():
        (tmp_path / name).write_bytes(body)
    heads = scans.read_heads(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in scans.unreadable(heads).collect()} == {"b.parquet": "no Parquet signature", "d.ndjson": "no JSON object", "e.log": "NUL bytes in text"}


def test_presentation(spark):
    row = spark.createDataFrame([("2024-07-01 22:30:05.25",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t")).select(present(F.col("t")), present(F.col("t"), "Europe/Berlin"), present(F.col("t"), "America/New_York", 12)).first()
    assert list(row) == ["2024-07-01 22:30:05.250", "2024-07-02 00:30:05.250", "2024-07-01 06:30:05.250 PM"]
    with pytest.raises(ValueError):
        present(F.lit(1), hours=13)


def test_row_elements(spark):
    heads = [("a", "<L><E><T/><T/></E><E/><E x='1'/></L>"), ("b", "<L><E/><E/></L>"), ("c", "<E></E>\n<E><P><P2/></P></E><E/>"), ("d", "<R><A><B/><B/><B/><B/></A><A/><A/></R>")]
    got = {r.file: (r.row, r.siblings, r.depth) for r in xmlrows.row_elements(spark.createDataFrame(heads, "file string, head string")).collect()}
    assert got == {"a": ("E", 3, 1), "c": ("E", 3, 0), "d": ("B", 4, 2)}


FILES = {
    "a.ndjson": b"whatever", "b.json": b'{"a": 1}\n{"a": 2}\n', "c.log": b'\xef\xbb\xbf{"a": {"b": 1}}\r\n', "d.pq": b"nope", "e.bin": b"PAR1....", "f.evtx": b"ElfFile\x00abc",
    "g.txt": b"-" * 30 + b"\nA: 1\n", "h.xml": b"<?xml version='1.0'?><a/>", "i.log": b"\n2024-03-18 06:00:00.123 [INF] [CS] [PID:1] m\n", "j.log": b"2024-03-18T06:00:00 gateway[4179]: queue depth 2347\n", "k.log": b"", "l.log": b"{broken\n",
}
EXPECTED = {"a.ndjson": ("ndjson", 90), "b.json": ("ndjson", 70), "c.log": ("ndjson", 90), "d.pq": ("parquet", 90), "e.bin": ("parquet", 100), "f.evtx": ("evtx", 100), "g.txt": ("block", 70), "h.xml": ("xml", 80), "i.log": ("line", 100), "j.log": (None, 0), "k.log": (None, 0), "l.log": (None, 0)}


def test_routing(spark, tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).write_bytes(body)
    heads = scans.read_heads(spark, str(tmp_path)).select("path", "head")
    got = {r.path.rsplit("/", 1)[1]: r for r in detect.classify_files(heads).collect()}
    assert {n: (r.adapter, r.score) for n, r in got.items()} == EXPECTED
    assert got["c.log"].notes == ["UTF-8 BOM", "CRLF line ends"] and "empty file" in got["k.log"].notes and "NUL bytes" in got["f.evtx"].notes
    assert got["i.log"].first_line.startswith("2024-03-18 06:00:00.123")
    report = detect.diagnose(heads).collect()
    assert len(report) == 6 * len(FILES) and all(r.reason for r in report)
    assert {r.path.rsplit("/", 1)[1]: r.adapter for r in report if r.chosen} == {n: a for n, (a, _) in EXPECTED.items() if a}
    formats.register_format("gateway", F.when(F.col("first_line").contains("gateway["), 60).otherwise(0), lambda s, p: s.read.text(p))
    try:
        assert {r.adapter for r in formats.classify(heads).collect() if r.path.endswith("j.log")} == {"gateway"}
    finally:
        formats.REGISTRY.clear()


def test_rules_are_checked():
    good = {"family": "line", "name": "x", "parse": r"^(?P<ts>\d+) (?P<message>.*)$", "ts_layout": "15"}
    loaded, problems = rules.load_rules({"b": good, "a": {"family": "odd"}, "c": {"family": "xml", "name": "y", "ts_layouts": "2006"}})
    assert [r.name for r in loaded] == ["x", "y"] and set(problems) == {"a"} and loaded[0].priority == 10 and loaded[1].ts_layouts == ("2006",)
    both = {"ts_use_mtime_date": True, "ts_use_mtime_year": True}
    for bad in (good | both, good | {"ts_layout": "%Y-%m-%d"}, good | {"ts_layout": "yyyy"}, good | {"ts_assume_tz": "Mars/Olympus"}, {"family": "xml", "name": "y", "ts_layouts": "%H"}, good | {"parse": "^(?P<message>.*)$"}, good | {"ts_layout": ""}, good | {"parse": "("}, good | {"colour": 1}, {"family": "block", "name": "z", "separator": "-", "field": "^(?P<key>.)$"}):
        with pytest.raises(ValueError):
            rules.load_rules({"r": bad})


SAMPLES = {
    "iso": ["2024-03-18T06:00:{:02d}.123Z {} [core] PID:{} start of job {}", "iso"],
    "slash": ["2024/03/18 06:00:{:02d} {} worker={} done {}", "iso-slash"],
    "clf": ["10.0.0.1 - - [18/Mar/2024:06:00:{:02d} +0000] {} {} {}", "clf"],
    "dash": ["18-03-2024 06:00:{:02d}.1 {} <{}> text {}", "dmy-dash"],
    "dot": ["app.Svc: 18.03.24 06:00:{:02d}:280 {} 36800/{} text {}", "dmy-dot"],
    "syslog": ["Mar 18 06:00:{:02d} {} web[{}]: text {}", "syslog"],
    "time": ["06:00:{:02d}.5 {} {}/77 text {}", "time-only"],
}


def test_inferred_templates_parse_their_own_lines(spark):
    import re

    data = [(s, i, p.format(i, ("INFO", "Warn", "ERROR")[i % 3], 100 + i, f"tail {i}")) for s, (p, _) in SAMPLES.items() for i in range(12)]
    df = spark.createDataFrame(data, "source string, line long, value string")
    got = {r.source: r for r in infer.templates(df).collect()}
    for source, (_, shape) in SAMPLES.items():
        r = got[source]
        assert r.shape == shape
        found = [re.match(r.pattern, v) for s, _, v in data if s == source]
        assert all(found) and all(m["ts"] and "message" in m.groupdict() for m in found), r.pattern
    assert re.match(got["iso"].pattern, data[0][2]).groupdict().keys() >= {"level", "pid"}
    assert "level" in got["dash"].pattern and got["dot"].aligned_on == "line"
    assert {r.source: r.zone for r in infer.zone_suffixes(df, infer.timestamp_shapes(df)).collect()}["iso"] == "Z07:00"
    layouts = {s: r.ts_layout for s, r in got.items()}
    assert layouts == {"iso": "2006-01-02T15:04:05Z07:00", "slash": "2006/01/02 15:04:05", "clf": "02/Jan/2006:15:04:05 -0700", "dash": "02-01-2006 15:04:05", "dot": "02.01.06 15:04:05", "syslog": "Jan _2 15:04:05", "time": "15:04:05"}
    ready = infer.line_rules(infer.templates(df))
    audited = {(r.source, r.rule): r for r in lines.audit(df, tuple(ready.values()), "source").collect()}
    for source in SAMPLES:
        r = audited[source, source]
        assert (r.parsed, r.timestamp_errors) == (12, 0), source
    assert ready["syslog"].ts_use_mtime_year and ready["time"].ts_use_mtime_date and ready["dot"].ts_regex_subs


def test_inferred_names_and_limits(spark):
    """Repeated labels, dotted numbers, a message after eight captures, month first."""
    import re

    rows = [("a", i, f"03/04/24 {i}") for i in range(4)] + [("b", i, f"12-{13 + i}-2024 06:00:00 id={i} id={2 * i} v1.{i}.{3 * i}.7 x") for i in range(5)]
    rows += [("c", i, f"2024-03-18 06:00:0{i} " + " ".join(str(i + k) for k in range(12))) for i in range(5)]
    got = {r.source: r for r in infer.templates(spark.createDataFrame(rows, "source string, line long, value string")).collect()}
    assert set(got) == {"b", "c"} and got["b"].ts_layout == "01-02-2006 15:04:05" and not got["b"].ambiguous
    m = re.match(got["b"].pattern, rows[6][2])
    assert m["id"] == "2" and m["id__2"] == "4"
    m = re.match(got["c"].pattern, rows[-1][2])
    assert m["field8"] == "11" and "field9" not in m.groupdict() and m["message"] == "12 13 14 15"


def test_histogram_adds_up(spark):
    df = spark.createDataFrame([(f"2024-03-18 {t}",) for t in ("10:00:00", "10:00:30", "10:01:10", "10:02:00")] + [("bad",), (None,)], "ts string")
    got = histogram.histogram(df, "ts").collect()
    assert sum(r.n for r in got) == 4 and len(got) == 4
    assert histogram.histogram(df.filter("ts = 'bad'"), "ts").count() == 0
    for s in [0, 1, 59, 119, 120, 121, 3600, 10**5, 10**6, 10**7, 10**8, 5 * 10**9]:
        w = max(1, pick_width(s))
        assert s // w <= 120 and (w in WIDTHS or w % 86400 == 0)


def test_exports_and_staging(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-03-{1 + i % 9:02d} 00:00:00", None if i % 2 else "x") for i in range(30)], "id long, ts string, v string")
    v = union_view({"a": df.withColumn("_source_format", F.lit("line:x"))})
    assert export(v, str(tmp_path / "o.ndjson"), "ts") == 30 and export(v, str(tmp_path / "o.parquet"), "ts", True) == 30
    back = [json.loads(x) for p in sorted((tmp_path / "o.ndjson").glob("part*")) for x in p.read_text().splitlines()]
    assert [r["ts"] for r in back] == sorted(r["ts"] for r in back) and set(back[0]) == {"id", "ts", "v", "_source_format"}
    assert spark.read.parquet(str(tmp_path / "o.parquet")).count() == 30
    stage(v.drop("_source"), str(tmp_path / "s"), "ts")
    staged = spark.read.parquet(str(tmp_path / "s"))
    assert staged.count() == 30 and "PartitionFilters: [isnotnull(event_date" in staged.filter("event_date = '2024-03-02'")._jdf.queryExecution().executedPlan().toString()


def test_typed_ranges_reach_the_scan(spark, sf_dir):
    v = union_view({n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("events", "orders")}, "typed")
    plan = v.filter(predicate(v, [], "ts", "2024-01-05 00:00:00")).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "o_orderkey" not in plan


def test_ndjson_scan_skips_broken_lines(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"Message": "a", "message": "b", "t": "2024-03-18T06:00:00Z"}\n{broken\n{"n": {"k": 1}}\n')
    df = scans.read_ndjson(spark, str(tmp_path))
    assert df.count() == 2 and {"Message", "message", "n"} <= set(df.columns)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("".join(f"2024-03-18 06:0{i % 3}:00.123 [INF] [CS] [PID:{i}] m\nnot a header\n" for i in range(9)))
    rows = tail.parse_stream(tail.stream_lines(spark, str(tmp_path / "in")), BY_NAME["iso-bracket"])
    counts = tail.stream_histogram(rows, "1 minute", "10 minutes", "level")
    run = counts.writeStream.format("memory").queryName("tail_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.level, r.n) for r in spark.table("tail_counts").collect()) == [("INF", 3)] * 3
    with pytest.raises(ValueError):
        tail.parse_stream(rows, BY_NAME["time-pidtid"])


def test_xml_paths_of_late_rows(spark):
    """An attribute, an element and a list that one row in three thousand has."""
    xml = ["<E><Id>%d</Id><Tag>a</Tag></E>" % i for i in range(3000)] + ['<E k="v"><Id>3000</Id><Tag>a</Tag><Tag>b</Tag><New><In>z</In></New></E>', None]
    rows = spark.createDataFrame([(x,) for x in xml], "xml string").repartition(1).sortWithinPartitions(F.length("xml"))
    got = xmlrows.parse_xml_rows(rows, "E")
    assert {"Id", "Tag", "@k", "New.In"} <= set(got.columns) and got.count() == 3002
    r = got.filter("Id = '3000'").first()
    assert (r["@k"], r["New.In"], r["Tag"]) == ("v", "z", ["a", "b"])
    assert got.filter("Id = '7'").first()["Tag"] == ["a"]


def test_event_lists_keep_every_item(spark):
    """Lists longer than four, in lists, and of records."""
    rows = [((1.0, list(range(7)), [([1, 2], [[1], [2, 3]]), (list(range(6)), None)]), None), ((2.0, [], None), None), ((3.0, None, []), None)]
    d = spark.createDataFrame(rows, "E struct<t: double, a: array<int>, r: array<struct<b: array<int>, m: array<array<int>>>>>, mtime timestamp")
    got = event_records.flatten_events(d, "E.t")
    want = {f"E.a.{i}": i for i in range(7)} | {f"E.r.1.b.{i}": i for i in range(6)} | {"E.r.0.b.1": 2, "E.r.0.m.1.1": 3, "E.r.0.m.0.0": 1, "E.r.0.m.0.1": None, "E.r.0.b.5": None}
    r = got.filter("`E.t` = 1").first().asDict()
    assert {k: r[k] for k in want} == want
    assert got.filter("`E.t` = 2").first()["E.a.0"] is None and got.count() == 3
