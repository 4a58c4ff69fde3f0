import random

import corpus_pipeline
import duckdb
import pytest
from loomlog.llm import queries
from tests.conftest import rows


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    from loomlog.llm import decontaminate, near_dup, pii, quality_model

    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        counts.append(docs.count())
        if name == "quality_model":
            kept = quality_model.resample(before, queries.good_ids(spark, sf_dir)).filter("kept")
            assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name == "near_dup":
            kept = near_dup.classify(before).filter("kept")
            assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name == "decontaminate":
            bad = decontaminate.find_contamination(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated")
            assert bad.count() == counts[-2] - counts[-1]
        if name == "pii":
            assert pii.find_pii(docs, ["doc_id"]).filter("size(spans) > 0").count() <= 2
        if name != "bpe":
            assert docs.columns == before.columns
    assert counts[0] > counts[1] > counts[2] and counts[-1] > 0.5 * counts[0]
    assert sorted(docs.drop("ids").collect()) == sorted(corpus_pipeline.run(spark, sf_dir).drop("ids").collect())


def test_pipeline_edges(spark, edge_rows, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns in every stage; then no rows at all."""
    from .conftest import SCHEMA

    base = spark.createDataFrame(edge_rows, SCHEMA)
    items = spark.createDataFrame([(1, "One two, three"), (2, None)], "item_id long, text string")
    for name, docs in (("some", base), ("none", base.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        items.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        spark.createDataFrame([(1, 1, 0), (8, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        before = docs
        for stage_name, stage in corpus_pipeline.STAGES:
            got = stage(spark, before, str(tmp_path / name)).cache()
            assert got.columns == docs.columns or stage_name == "bpe"
            assert got.count() <= before.count() and (name == "some") == (got.count() > 0), stage_name
            before = got
        rows_of = lambda df: sorted(str((r.doc_id, r.n_tokens)) for r in df.collect())
        assert rows_of(corpus_pipeline.run(spark, str(tmp_path / name))) == rows_of(before)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    sql = queries.ORACLE_SQL[name]
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql).df()
    got = queries.QUERIES[name](spark, sf_dir).select(*want.columns)
    plain = sorted(tuple("NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in (r[c] for c in sorted(want.columns))) for r in want.astype(object).to_dict("records"))
    assert rows(got) == plain


def test_account_numbers_equal_the_sql(spark, tmp_path):
    """Numbers beside letters, underscores, each other and failing ones, which the given tables lack."""
    rng = random.Random(1)
    known = ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89370400440532013001"]
    between = [" ", "_", ".", "\n", "x", "é", "-", "", "  ", ", ", "pay", "A1", "iban_", "+49 170 1234567", "a@b.cd", " EUR ", " BIC COBADEFFXXX ", "example ", " account ", " 2024 ", " test, "]
    texts = ["".join(rng.choice(known if rng.random() < 0.5 else between) for _ in range(9)) for _ in range(300)]
    spark.createDataFrame([*enumerate(texts), (300, None), (301, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op9_pii"])
    got = queries.op9_pii(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and sum("iban" in r.spans for r in got) > 80
    assert {x for r in got for s, x in zip(r.spans.split(","), r.scores.split(","), strict=True) if s.startswith("iban")} == {"0.55", "0.75", "0.85"}


def test_every_query_gives_a_row_a_document(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert sum(len(r.spans) > 0 for r in queries.op9_pii(spark, sf_dir).collect()) > 0
    for name in ("op2_near_dup", "op3_quality_model", "op4_toxicity", "op6_language", "op8_sharding"):
        got = queries.QUERIES[name](spark, sf_dir)
        assert got.count() == n, name
