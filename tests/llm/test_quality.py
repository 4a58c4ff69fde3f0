import math
import random
import re

import numpy as np
import pyarrow as pa
from loomlog.llm import quality_model, quality_rules
from pyspark.sql import functions as F

from .conftest import words


def labelled(spark, n=300):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        if i % 5:
            rows.append((i, words(rng, rng.randrange(40, 150), 300), 1))
        else:
            rows.append((i, " ".join(f"w{rng.randrange(300)}###" for _ in range(80)) if i % 2 else "spam " * 100, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_resampling_keeps_the_good(spark):
    d = labelled(spark)
    good = d.filter("quality = 1 AND doc_id % 2 = 1").select("doc_id")
    got = quality_model.resample(d.drop("quality"), good).join(d.select("doc_id", "quality"), "doc_id")
    assert got.filter("quality = 0 AND kept").count() == 0
    assert got.filter("quality = 1 AND kept").count() >= 0.97 * d.filter("quality = 1").count()
    kept = quality_model.keep_good(d.drop("quality"), good)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got.filter("kept").collect())


def test_top_k_is_exact(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 1000) for _ in range(3000)] + [5.0] * 500
    d = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 1400, 1700, 3000, 3500):
        assert quality_model.kth_largest(d, "key", k, bins=20, few=50) == sorted(values)[-k]


def test_sampling_follows_weights(spark):
    """Without a model all weights are equal, and the noise alone decides: k rows, the same each time."""
    d = labelled(spark)
    got = quality_model.resample(d, d.select("doc_id").limit(0), k=100)
    assert got.filter("kept").count() == 100
    again = quality_model.resample(d, d.select("doc_id").limit(0), k=100)
    assert got.filter("kept").join(again.filter("kept"), "doc_id").count() == 100


def test_model_edges(spark, edge, empty):
    good = edge.select("doc_id")
    got = quality_model.resample(edge, good)
    assert got.count() == edge.count()
    assert got.filter("doc_id IN (2, 3)").select("log_weight").distinct().collect() == [(0.0,)]
    assert quality_model.keep_good(edge, good).columns == edge.columns
    assert quality_model.resample(empty, good).count() == 0
    assert quality_model.keep_good(empty, good.limit(0)).count() == 0
    assert not quality_model.fit(edge, good.limit(0)).target.any()


def plain_weights(texts, shown):
    """Log weights of texts by dictionaries of tokens, each shown text left out of its own target model."""
    from collections import Counter

    def grams(text):
        tokens = re.findall("[0-9a-z\x80-\U0010ffff]+|[!-/:-@\\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        out = [int(g) for g in quality_model.ngrams(pa.array([text]))[1]]
        assert len(out) == max(0, 2 * len(tokens) - 1)
        return Counter(out)

    each = [grams(t) for t in texts]
    raw, target = Counter(), Counter()
    for g, s in zip(each, shown, strict=True):
        raw += g
        target += g if s else Counter()
    n_raw, n_target, prior = sum(raw.values()) + quality_model.BUCKETS, sum(target.values()), quality_model.PRIOR
    out = []
    for g, s in zip(each, shown, strict=True):
        held, size, total = (g if s else {}), sum(g.values()), 0.0
        for b, times in g.items():
            p = (raw[b] + 1) / n_raw
            total += times * math.log((target[b] - held.get(b, 0) + prior * p) / (n_target - sum(held.values() if s else []) + prior) / p)
        out.append(total * min(1, quality_model.LENGTH / max(size, 1)))
    return out


def test_log_weights_against_plain_python(spark):
    rng = random.Random(12)
    texts = [words(rng, rng.randrange(0, 160), 90) + rng.choice(["", ", A-b. ###", " x x x x"]) for _ in range(80)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    good = d.filter("doc_id % 3 = 0").select("doc_id")
    got = {r.doc_id: r for r in quality_model.resample(d, good).collect()}
    assert np.allclose([got[i].log_weight for i in range(80)], plain_weights(texts, [i % 3 == 0 for i in range(80)]))
    assert [got[i].target for i in range(80)] == [i % 3 == 0 for i in range(80)]


def test_unseen_good_documents_are_kept_like_shown_ones(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = quality_model.resample(docs, labels.filter("quality = 1").filter(half).select("doc_id")).join(labels, "doc_id", "left")
    share = {(r.quality, r.target): r.share for r in got.groupBy("quality", "target").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1, True] >= 0.9 and abs(share[1, True] - share[1, False]) <= 0.05 and share[0, False] <= 0.2


def base(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    from collections import Counter

    n = Counter(tri)
    hit = {j for i, t in enumerate(tri) if n[t] > 1 for j in (i, i + 1, i + 2)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit)


def test_rules_against_brute_force(spark, edge, empty):
    rng = random.Random(9)
    texts = ["\n".join(words(rng, rng.randrange(0, 8), 6) for _ in range(rng.randrange(0, 12))) + rng.choice(["", " # * |", "\r\n\x0b x", " ..."]) for _ in range(120)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for df in (d, edge.select("doc_id", "text", "n_words")):
        for r in quality_rules.judge(df, df.columns).collect():
            n, chars, symbols, dup, rep = base(r["__keep"].text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
            assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
            assert not (r.kept and r.base_failed)
    assert quality_rules.judge(empty, ["doc_id"]).count() == 0
    plan = quality_rules.judge(d, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_prose_is_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    judged = quality_rules.judge(docs, ["doc_id", "quality"]).filter("__keep.quality = 1 AND NOT base_failed")
    assert judged.filter(~F.col("kept")).count() == 0
