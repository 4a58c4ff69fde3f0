"""Heads of huge and empty files, and loads that go on past bad ones."""

import os

import pytest
from loomlog.sources import loading
from loomlog.sources.scans import read_heads
from pyspark.sql import functions as F


def name(path):
    return path.rsplit("/", 1)[1]


@pytest.fixture()
def landing(spark, tmp_path):
    """Good and bad files of two formats: cut short, damaged in a middle page, broken in the middle, empty."""
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
    rows.coalesce(1).write.option("parquet.block.size", 200_000).option("compression", "gzip").parquet(str(tmp_path / "made"))
    made = next(p for p in (tmp_path / "made").iterdir() if p.suffix == ".parquet").read_bytes()
    at = tmp_path / "in"
    at.mkdir()
    (at / "good one+two.parquet").write_bytes(made)
    (at / "cut.parquet").write_bytes(made[: len(made) * 3 // 4])
    middle = len(made) // 2
    (at / "page.parquet").write_bytes(made[:middle] + b"\xff" * 4000 + made[middle + 4000 :])
    (at / "text.parquet").write_text("no parquet at all")
    (at / "good.ndjson").write_text("".join(f'{{"a": {i}, "t": "x"}}\n' for i in range(500)))
    (at / "broken.ndjson").write_text("".join(f'{{"a": {i}}}\n' if i != 250 else '{"a": 25\n' for i in range(500)))
    (at / "bom.ndjson").write_bytes(b"\xef\xbb\xbf" + b'{"a": 1}\r\n\r\n{"a": 2}\r\n')
    (at / "list.jsonl").write_text("[1, 2]\n[3]\n")
    (at / "empty.ndjson").write_text("")
    return at


def test_heads_of_huge_and_empty_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    with open(tmp_path / "huge.bin", "wb") as f:
        f.write(b"begin" + b"x" * 100_000)
        f.truncate(10 << 30)  # 10 GB, without blocks on disk
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "sub" / "small.log").write_text("abc")
    for n in (512, 16 << 10):
        got = {name(r.path): r for r in read_heads(spark, str(tmp_path), n).collect()}
        assert {k: (r.size, len(r.head)) for k, r in got.items()} == {"huge.bin": (10 << 30, n), "empty.log": (0, 0), "small.log": (3, 3)}
        assert got["huge.bin"].head.startswith(b"begin") and got["huge.bin"].mtime is not None
    both = read_heads(spark, [str(tmp_path / "sub"), "file://" + str(tmp_path / "*.log")]).collect()
    assert sorted(name(r.path) for r in both) == ["empty.log", "small.log"]
    with pytest.raises(Exception, match="nothing"):
        read_heads(spark, str(tmp_path / "nothing")).count()


def test_files_that_cannot_be_opened(spark, tmp_path):
    os.symlink(tmp_path / "gone", tmp_path / "dangling.log")
    (tmp_path / "fine.log").write_text("fine")
    got = {name(r.path): (r.head, r.problem is None) for r in read_heads(spark, str(tmp_path)).collect()}
    assert got["fine.log"] == (b"fine", True) and got.get("dangling.log", (None, False)) == (None, False)


def test_bad_files_are_reported_and_the_others_load(spark, landing):
    loaded, problems = loading.load_files(spark, str(landing))
    reasons = {name(r.path): r.reason for r in problems.collect()}
    assert set(reasons) == {"cut.parquet", "page.parquet", "text.parquet", "broken.ndjson", "list.jsonl", "empty.ndjson"}
    assert reasons["cut.parquet"].startswith("no Parquet footer") and "of 20000 rows" in reasons["page.parquet"]
    assert reasons["broken.ndjson"] == '1 of 500 lines are no JSON objects, first: {"a": 25' and reasons["empty.ndjson"] == "empty file"
    parquet = loaded["parquet"]
    assert {name(r.file) for r in parquet.select("file").distinct().collect()} == {"good one+two.parquet"} and parquet.select("id", "s").distinct().count() == 20_000
    assert {name(r.file): r.n for r in loaded["ndjson"].groupBy("file").agg(F.count("a").alias("n")).collect()} == {"good.ndjson": 500, "bom.ndjson": 2}
    assert loaded["ndjson"].columns == ["a", "t", "file"]


def test_only_bad_files(spark, landing):
    got = loading.load_parquet(spark, [f"file://{landing}/cut.parquet"])
    assert got.rows.count() == 0 and got.problems.count() == 1
    got = loading.load_ndjson(spark, [f"file://{landing}/broken.ndjson"], "a int")
    assert got.rows.columns == ["a", "file"] and got.rows.count() == 0 and got.problems.count() == 1
