"""Kept sketches and trigram bitmaps of files: what they save, and that they lose nothing."""

import random

from loomlog.operators.predicates import search
from loomlog.sources import sidecars
from pyspark.sql import functions as F


def files_in(path):
    return sorted(p.name for p in path.rglob("*.parquet"))


def test_index_of_changing_files(spark, tmp_path):
    data, at = tmp_path / "data", tmp_path / "index"
    rows = spark.range(4000).select("id", (F.col("id") % 700).cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), F.when(F.col("id") % 4 > 0, F.lit("x")).alias("some"))
    for i in range(4):
        rows.filter(F.floor(F.col("id") / 1000) == i).coalesce(1).write.parquet(str(data / f"f{i}"))
    index = sidecars.refresh(spark, [str(data)], str(at))
    got = {r.field: r for r in sidecars.profile(index).collect()}
    assert (got["id"].present, got["id"].total, got["some"].present) == (4000, 4000, 3000)
    assert abs(got["k"].distinct - 700) < 35 and got["some"].distinct == 1 and abs(got["id"].distinct - 4000) < 200
    bounds = {r.field: (str(r.first_ts), str(r.last_ts)) for r in sidecars.bounds(index).collect()}
    assert bounds == {"t": ("1970-01-01 00:00:00", "1970-01-03 18:39:00")}
    before = files_in(at)
    sidecars.refresh(spark, [str(data)], str(at))
    assert files_in(at) == before  # nothing new, nothing read
    rows.filter("id < 10").coalesce(1).write.mode("overwrite").parquet(str(data / "f3"))
    spark.createDataFrame([(1, "only here")], "id long, extra string").coalesce(1).write.parquet(str(data / "f4"))
    index = sidecars.refresh(spark, [str(data)], str(at))
    assert len(files_in(at)) > len(before) and index.fields.select("path").distinct().count() == 5
    got = {r.field: r for r in sidecars.profile(index).collect()}
    assert (got["id"].present, got["id"].total, got["extra"].present) == (3011, 3011, 1)
    new = spark.read.parquet(str(at / "fields")).filter("field = 'id'").groupBy("path").count()
    assert sorted(r["count"] for r in new.collect()) == [1, 1, 1, 1, 1, 1]  # three old files once, the changed one's two states, the new one


def test_searches_lose_nothing_and_skip_files(spark, tmp_path):
    rng = random.Random(3)
    letters = "abcdeXYZ é中ß0123.-"
    data = [(i // 50, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) or None, rng.randrange(10_000)) for i in range(600)]
    rows = spark.createDataFrame(data, "part int, text string, n int")
    rows.repartition(12, "part").write.partitionBy("part").parquet(str(tmp_path / "d"))
    index = sidecars.refresh(spark, [str(tmp_path / "d")], str(tmp_path / "i"))
    all_ = spark.read.parquet(str(tmp_path / "d"))
    n_files, read = index.files.count(), []
    texts = [t for _, t, _ in data if t]
    for _ in range(12):
        t = rng.choice(texts)
        lo = rng.randrange(len(t))
        asked = t[lo : lo + rng.randrange(1, 9)]
        asked = rng.choice([asked, asked.upper(), asked.lower(), str(rng.randrange(10_000)), asked[:2] + "%" + asked[3:]])
        want = sorted(map(str, all_.filter(search(all_, asked)).select("text", "n").collect()))
        assert sorted(map(str, sidecars.search_files(spark, index, asked).select("text", "n").collect())) == want, asked
        read.append(sidecars.may_hold(index, asked).count())
    assert sidecars.may_hold(index, "abcdexyz0123 nowhere").count() == 0 and sidecars.search_files(spark, index, "abcdexyz0123 nowhere").count() == 0
    assert sum(read) < 0.8 * n_files * len(read), read  # most of these texts are short; longer ones meet a file or two
    whole = max(texts, key=len)
    assert sidecars.may_hold(index, whole, literal=True).count() <= 2
