from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from loomlog.functions.fields import list_fields, pick_timestamp_field, resolve
from loomlog.operators import pages, profile
from loomlog.operators.predicates import Filter, condition, filters, predicate, preset
from loomlog.operators.union import union_view
from loomlog.sources.scans import configure
from loomlog.sources.source_set import SourceSet
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def view(spark):
    configure(spark)
    a = spark.createDataFrame([(1, "Alpha", "x\\b"), (2, "beta", ""), (3, None, "50%")], "id int, Message string, tag string")
    b = spark.createDataFrame([("GAMMA", 2.5)], "message string, amount double")
    return union_view({"a": a, "b": b})


def test_first_casing_wins_and_missing_is_null(view):
    assert view.columns == ["id", "Message", "tag", "amount", "_source"]
    assert set(view.dtypes) == {(c, "string") for c in view.columns}
    assert view.filter("_source = 'b'").select("id", "Message", "amount").collect() == [(None, "GAMMA", "2.5")]


def test_case_duplicates_coalesce_in_order(spark):
    configure(spark)
    df = spark.createDataFrame([(None, "low"), ("High", "low")], "Message string, message string")
    assert sorted(r.Message for r in union_view({"a": df}).collect()) == ["High", "low"]


def test_typed_view_keeps_agreed_types(spark):
    a = spark.createDataFrame([(1, "x")], "n long, m string")
    b = spark.createDataFrame([(2, 3)], "n long, m int")
    typed = union_view({"a": a, "b": b}, "typed")
    assert dict(typed.dtypes)["n"] == "bigint" and dict(typed.dtypes)["m"] == "string"


CASES = {
    ("is", "ALPHA"): {"Alpha"}, ("is_not", "alpha"): {"beta", "GAMMA"}, ("contains", "A"): {"Alpha", "beta", "GAMMA"}, ("not_contains", "ph"): {"beta", "GAMMA"},
    ("wildcard", "*ta"): {"beta"}, ("wildcard", "bet?"): set(), ("not_wildcard", "*ta"): {"Alpha", "GAMMA"}, ("exists", ""): {"Alpha", "beta", "GAMMA"}, ("does_not_exist", ""): {None},
    ("is_one_of", "beta , alpha,"): {"Alpha", "beta"}, ("is_not_one_of", "beta"): {"Alpha", "GAMMA", None},
}


@pytest.mark.parametrize("case", CASES)
def test_operators_and_their_nulls(view, case):
    assert {r.Message for r in view.filter(filters(view, [Filter("message", *case)])).collect()} == CASES[case]


def test_special_characters(view):
    assert view.filter(filters(view, [Filter("tag", "contains", "\\b")])).count() == 1
    assert view.filter(filters(view, [Filter("tag", "contains", "%")])).count() == 3
    assert view.filter(filters(view, [Filter("tag", "contains", "%")], literal=True)).count() == 1


def test_incomplete_filters_do_not_count(view):
    assert filters(view, [Filter("", "is", "x"), Filter("id", "is", ""), Filter("id", "odd", "1"), Filter("id", "is_one_of", " , ")]) is None
    chain = [Filter("id", "is", ""), Filter("id", "is", "1"), Filter("id", "is", "2", "or"), Filter("message", "contains", "zz", "and")]
    assert [r.id for r in view.filter(filters(view, chain)).collect()] == ["1"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.sampled_from(["", "a", "A", "ab", "b%"])), max_size=8), st.sampled_from(["a", "ab", "b%"]))
def test_is_and_is_not_split_non_null_rows(spark, values, wanted):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    n = {op: df.filter(condition(F.col("v"), op, wanted)).count() for op in ("is", "is_not", "exists", "does_not_exist", "is_one_of", "is_not_one_of")}
    assert n["is"] + n["is_not"] == sum(v is not None for v in values)
    assert n["exists"] + n["does_not_exist"] == len(values) == n["is_one_of"] + n["is_not_one_of"]
    assert n["is"] == sum(v is not None and v.lower() == wanted for v in values)


def test_every_spelling_of_an_instant(spark):
    spelled = ["2024-03-18 06:00:00", "2024-03-18T06:00:00Z", "2024-03-18T06:00:00.000Z", "2024-03-18 05:59:59.999", "06:00:00", "2024", "junk", None]
    df = spark.createDataFrame([(s,) for s in spelled], "ts string")
    for start in ("2024-03-18 06:00:00", "2024-03-18T06:00:00Z", "2024-03-18T06:00:00", "2024-03-18 06:00:00.000"):
        assert df.filter(predicate(df, [], "ts", start)).count() == 3


def test_fields(spark):
    df = spark.createDataFrame([((1, (2,)), "{\"k\": {\"z\": 5}}", "dot")], "a struct<b:int,c:struct<d:int>>, js string, `x.y` string")
    assert list_fields(df) == ["a", "js", "x.y", "a.b", "a.c", "a.c.d"]
    got = df.select(resolve(df, "A.C.D").alias("d"), resolve(df, "js.k.z").alias("z"), resolve(df, "X.Y").alias("y")).first()
    assert tuple(got) == (2, "5", "dot")
    with pytest.raises(KeyError):
        resolve(df, "a.nope")
    assert pick_timestamp_field(["id", "created_at", "Time"]) == "Time" and pick_timestamp_field(["id", "my_date"]) == "my_date" and pick_timestamp_field(["id"]) == "id" and pick_timestamp_field([]) == "@timestamp"


def test_pages(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(20)], "id int, v int")
    for down in (False, True):
        every = [r.id for r in pages.page(df, "v", down, limit=20, ties=["id"]).collect()]
        assert every[-4:] == [0, 5, 10, 15]
        assert [r.id for o in (0, 7, 14) for r in pages.page(df, "v", down, 7, o, ["id"]).collect()] == every
    deep, after = [], None
    while got := pages.keyset_page(df, ["id"], after, 6).collect():
        deep += [r.id for r in got]
        after = [got[-1].id]
    assert deep == list(range(20)) and pages.page_of(20, 6, 12) == (3, 4) and pages.page_of(0, 10, 0) == (1, 1)


def test_profile_agrees_with_exists(view):
    got = {r.field: r for r in profile.profile(view, exact=True).collect()}
    for name, r in got.items():
        assert r.present == view.filter(filters(view, [Filter(name, "exists")])).count()
    assert (got["Message"].distinct, got["Message"].sources, got["Message"].sources_total, got["tag"].fill) == (3, 2, 2, 0.5)
    near = {r.field: r.distinct for r in profile.profile(view).collect()}
    assert near == {n: r.distinct for n, r in got.items()}


def test_samples(spark):
    df = spark.createDataFrame([(str(i), "b" if i % 2 else "a", "") for i in range(50)], "many string, few string, none string")
    got = {r.field: r["values"] for r in profile.field_samples(df, ["many", "few", "none", "absent"], cap=30).collect()}
    assert got == {"many": [], "few": ["a", "b"], "none": []}


def test_source_set(spark, tmp_path):
    s = SourceSet(spark).add("a", spark.range(3).withColumnRenamed("id", "Time"), str(tmp_path / "a")).add("b", spark.range(2))
    for name, path in (("a", None), ("c", str(tmp_path / "a"))):
        with pytest.raises(ValueError):
            s.add(name, spark.range(1), path)
    assert s.timestamp_field == "Time" and s.files_declaring() == {"time": 1, "id": 1}
    assert s.enable("a", False).view().count() == 2
    assert {(r.source, r.enabled, r.records) for r in s.listing().collect()} == {("a", False, 3), ("b", True, 2)}
    assert list(s.drop("a").sources) == ["b"]


def test_presets():
    now = datetime(2024, 3, 18, 6, 30)
    assert preset("15m", now) == ("2024-03-18 06:15:00", "2024-03-18 06:30:00")
    assert preset("today", now)[0] == "2024-03-18 00:00:00"
