"""Top values, deep pages and long records against their plain counterparts."""

import random
import time
from collections import Counter

import pytest
from loomlog.operators import export, heavy, histogram, infer, lines, rules, xmlrows
from loomlog.operators.jump import jump_page
from loomlog.operators.pages import page
from loomlog.operators.profile import top_values
from pyspark.sql import functions as F


def test_summaries_bound_their_error():
    rng = random.Random(4)
    for _ in range(60):
        values = [str(int(rng.paretovariate(rng.choice([0.3, 1, 3])))) for _ in range(rng.randrange(1, 4000))]
        total, error, true = Counter(), 0, Counter(values)
        for lo in range(0, len(values), 500):  # a summary a task
            summary = heavy.Summary(16)
            for at in range(lo, min(lo + 500, len(values)), 100):
                counted = Counter(values[at : min(at + 100, lo + 500)])
                summary.add(list(counted), list(counted.values()))
            summary.shrink()
            assert len(summary.counts) <= 16
            total.update(summary.counts)
            error += summary.error
        assert all(total[v] <= n <= total[v] + error for v, n in true.items())


def test_heavy_hitters_of_a_million_values(spark):
    """A few frequent values among 600,000 others: proven from summaries, and only candidates are counted."""
    rows = spark.range(1_200_000).repartition(8).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("hot"), F.floor(F.sqrt(F.col("id") % 400)).cast("string"))).otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None,), ("",)] * 5, "v string"))
    some = heavy.candidates(rows.filter("v <> ''"), 10, held=512)
    assert some is not None and some.count() < 100
    assert heavy.heavy_hitters(rows, "v", 10, held=512).collect() == top_values(rows, "v", 10).collect()


def test_heavy_hitters_where_nothing_is_proven(spark):
    rows = spark.range(5000).select((F.col("id") % 1000).cast("string").alias("v"))
    assert heavy.candidates(rows, 5, held=32) is None
    assert heavy.heavy_hitters(rows, "v", 5, held=32).collect() == top_values(rows, "v", 5).collect()
    assert heavy.heavy_hitters(rows.limit(0), "v", 5).count() == 0
    few = rows.filter("v < '2'")
    assert heavy.heavy_hitters(few, "v", 500).collect() == top_values(few, "v", 500).collect()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("field", ["n", "t", "hot"])
def test_pages_anywhere(spark, field, descending):
    """Numbers, texts, and a value that half the rows have; nulls; offsets before, inside and behind."""
    rng = random.Random(9)
    data = [(i, rng.choice([None, rng.randrange(50), rng.random() * 100]), rng.choice([None, "é", "a", f"x{rng.randrange(500)}"]), rng.choice([7, rng.randrange(10)])) for i in range(3000)]
    rows = spark.createDataFrame([(i, None if n is None else float(n), t, h) for i, n, t, h in data], "id int, n double, t string, hot int").repartition(4)
    for offset, limit in ((0, 10), (1234, 50), (2990, 50), (2999, 1), (3000, 5), (9999, 5)):
        got = jump_page(rows, field, descending, limit, offset, ["id"], few=100)
        assert got.columns == rows.columns and got.collect() == page(rows, field, descending, limit, offset, ["id"]).collect()


@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages_compare_in_compiled_code(spark, descending):
    """No row is held against a list of boundaries by a lambda."""
    rows = spark.range(5000).select("id", (F.col("id") % 700).alias("n"))
    got = jump_page(rows, "n", descending, 20, 4500, ["id"], few=100)
    assert "lambda" not in got._jdf.queryExecution().toString()
    assert got.collect() == page(rows, "n", descending, 20, 4500, ["id"]).collect()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_deep_pages_of_times_in_any_zone(spark, monkeypatch, kind, descending):
    """The driver's zone isn't the session's, and its clock shows one of the two hours twice: still one range is sorted."""
    made = spark.range(7200).select("id", F.timestamp_seconds(F.lit(1730610000) + F.col("id")).alias("t"))  # 2024-11-03 05:00 UTC
    rows = made.select("id", F.when(F.col("id") % 90 > 0, F.col("t").cast(kind)).alias("t"))
    want = [r.id for r in page(rows, "t", descending, 20, 6400, ["id"]).collect()]
    left, order = [], type(rows).orderBy
    monkeypatch.setenv("TZ", "America/New_York")
    monkeypatch.setattr(type(rows), "orderBy", lambda df, *columns: left.append(df.count()) or order(df, *columns))
    time.tzset()
    try:
        got = [r.id for r in jump_page(rows, "t", descending, 20, 6400, ["id"], few=500).collect()]
    finally:
        monkeypatch.undo()
        time.tzset()
    assert got == want and left[0] <= 500


def test_one_long_record_in_pieces(spark):
    """A record of 40,000 lines: the pieces are small, and put together they are the folded message."""
    head = "2024-01-01 00:00:00.000 [INF] [DB] [PID:1] begin"
    texts = ["before", head, *[f"  line {i} {'é' * (i % 50)}" if i % 9 else "   " for i in range(40_000)], head.replace("begin", "second"), head.replace("begin", "third"), "more"]
    df = spark.createDataFrame([("f", i // 1000, i, t) for i, t in enumerate(texts)], "file string, part long, seq long, value string").repartition(5)
    rule = rules.LINE_RULES[0]
    records, pieces = lines.fold_in_pieces(df, rule, 20_000)
    want = {r.seq: r.message for r in lines.fold_records(df, rule).collect()}
    found = sorted(map(tuple, pieces.select("head_seq", "piece", "text").collect()))
    assert len(found) > 50 and max(len(t.encode()) for *_, t in found) < 20_200
    for r in records.collect():
        more = [t for s, _, t in found if s == r.seq]
        assert "\n".join([r.message, *more]) == want[r.seq] and r.n_bytes == sum(len(t.encode()) + 1 for t in more)
    assert {r.seq: r.n_more for r in records.collect()} == {1: sum(1 for i in range(40_000) if i % 9), 40_002: 0, 40_003: 1}


def test_one_pass_histogram_of_any_span(spark):
    """Spans from none to centuries, dealt so that tasks see parts of different width, times before the origin."""
    rng = random.Random(1)
    for span in (0, 1, 100, 250, 5000, 100_000, 10_000_000, 90_000_000, 3_000_000_000):
        start = rng.choice([0, 500_000_000, 1_700_000_000])
        near = [start + rng.random() * min(span, 300) for _ in range(200)]
        seconds = [start, start + span, *near, *[start + rng.random() * span for _ in range(300)]]
        rows = spark.createDataFrame([(float(x),) for x in sorted(seconds)] + [(None,)], "s double").select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts")).repartitionByRange(5, "ts")
        assert histogram.one_pass_histogram(rows, "ts").collect() == histogram.histogram(rows, "ts").collect(), span
    assert histogram.one_pass_histogram(rows.limit(0), "ts").count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_rows_without_the_field_are_dealt_over_files(spark, tmp_path, monkeypatch, descending):
    monkeypatch.setattr(export, "RANGE_ROWS", 100, raising=False)
    rows = spark.range(3000).repartition(3).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("ts"))
    path = str(tmp_path / "o.parquet")
    assert export.export(rows, path, "ts", descending) == 3000
    files = [list(map(tuple, spark.read.parquet(str(p)).collect())) for p in sorted((tmp_path / "o.parquet").glob("*.parquet"))]
    assert max(len(f) for f in files) < 700
    got = [r for f in files for r in f]
    assert sorted(i for i, _ in got) == list(range(3000))
    assert [ts for _, ts in got] == sorted(range(0, 3000, 10), reverse=descending) + [None] * 2700


def test_row_elements_without_sorting_tags(spark):
    """Tags are counted where the head stands; closing tags too many, tags that close themselves, comments."""
    heads = [("a", "<r><e/><e/><e/></r>"), ("b", "</x></x><e/><e/><e></e>"), ("c", "<!-- <e/> --><r><e/><e/></r>"), ("d", None), ("e", "<r>" + "<p><q/><q/></p>" * 4 + "</r>")]
    got = xmlrows.row_elements(spark.createDataFrame(heads, "file string, head string"))
    assert "Window" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [("a", "e", 3, 1), ("b", "e", 3, -2), ("e", "p", 4, 1)]


def test_timestamps_of_one_form_are_looked_at_once(monkeypatch):
    calls, votes = [], infer._VOTES
    monkeypatch.setattr(infer, "_VOTES", [lambda ts, v=v: calls.append(ts) or v(ts) for v in votes])
    source, kinds = infer._Source("iso"), {}
    for i in range(500):
        source.add(f"{'x ' if i % 2 else ''}2024-01-{i % 28 + 1:02d}T00:00:00.{i:03d}+0200 INF n{i}", kinds)
    got = list(source.rows("a"))
    assert len(calls) == len(votes)
    assert got[-1][3] == 500 and dict(zip(infer.STAMP_VOTES, got[-1][10:], strict=False)) == {"between_t": 500, "short": 0, "colon": 0, "zone_colon": 0, "zone_plain": 500}
    texts = {(r[1], r[2]): r[-4:-2] for r in got}
    assert texts["line", 0] == ("2024-01-01T00:00:00.000+0200", "x") and texts["timestamp", 0] == ("2024-01-01T00:00:00.000+0200", "2024-01-28T00:00:00.475+0200")
