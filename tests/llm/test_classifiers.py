import random

import numpy as np
import pyarrow as pa
import pytest
from loomlog.llm import language, toxicity
from pyspark.sql import functions as F

from .conftest import words


def toxic_corpus(n=500):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(40, 200), 300).split(" ")
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "rotten" + rng.choice("abcdef")])
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


def test_network_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((6, toxicity.DIM))
    ids = rng.integers(-1, 6, (3, toxicity.WINDOW))
    y, weight = np.array([0.0, 1.0, 1.0]), np.ones(3)

    def loss():
        z = net.forward(net.gates(x), ids)[0]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    got = net.gradients(x, ids, y, weight)
    for name in ("W", "V", "B", "A", "O", "o"):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in net.p[name].shape)
            old, h = net.p[name][at], 1e-3
            net.p[name][at] = old + h
            up = loss()
            net.p[name][at] = old - h
            down = loss()
            net.p[name][at] = old
            assert got[name][at] == pytest.approx((up - down) / (2 * h), abs=2e-3), name
    old, h = x[2, 3], 1e-3
    x[2, 3] = old + h
    up = loss()
    x[2, 3] = old - h
    assert got["x"][2, 3] == pytest.approx((up - loss()) / (2 * h), abs=2e-3)


def test_held_out_toxicity():
    texts, labels = toxic_corpus()
    net = toxicity.train(texts[:400], labels[:400])
    score, n, at = net.score(pa.array(texts[400:]))
    assert ((score >= 0.5) == labels[400:]).mean() >= 0.9
    long = words(random.Random(1), 500, 300).split(" ")
    long[333] = "vile"
    long[335] = "vile"
    score, n, at = net.score(pa.array([" ".join(long)]))
    assert n[0] == 1 + -(-(500 - toxicity.WINDOW) // toxicity.STRIDE) and at[0] <= 333 < at[0] + toxicity.WINDOW


def test_scores_against_a_plain_network():
    """Word by word in plain Python: features, both units, attention, the highest window."""
    rng = random.Random(4)
    net = toxicity.Network.fresh(3)
    net.p["o"][:], net.p["scale"][:], net.p["shift"][:] = 0.2, 1.5, -0.1
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    H = toxicity.HIDDEN

    def plain(text):
        tokens, inverse, owner, bucket, weight = toxicity.word_inputs(pa.array([text]))
        words = [sum(w * p["E"][b] for o, b, w in zip(owner, bucket, weight, strict=True) if o == i) for i in inverse]
        starts = list(range(0, max(1, len(words) - toxicity.WINDOW + 1), toxicity.STRIDE))
        if len(words) > toxicity.WINDOW and starts[-1] + toxicity.WINDOW < len(words):
            starts.append(len(words) - toxicity.WINDOW)
        tops = []
        for s in starts:
            x = words[s : s + toxicity.WINDOW]
            states = [[], []]
            for d in (0, 1):
                h = np.zeros(H)
                for v in x if d == 0 else x[::-1]:
                    g = v @ p["W"][d] + p["B"][d]
                    r, z = np.split(sig(g[: 2 * H] + h @ p["V"][d][:, : 2 * H]), 2)
                    h = h + z * (np.tanh(g[2 * H :] + (r * h) @ p["V"][d][:, 2 * H :]) - h)
                    states[d].append(h)
            both = np.array([np.concatenate([a, b]) for a, b in zip(states[0], states[1][::-1], strict=True)])
            e = np.exp(both @ p["A"])
            tops.append(float((e / e.sum()) @ both @ p["O"] + p["o"][0]))
        return sig(p["scale"][0] * max(tops) + p["shift"][0])

    texts = [words(rng, n, 60) for n in (1, 5, 32, 33, 47, 48, 49, 130)]
    got = net.score(pa.array(texts))[0]
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-5)
    alone = [net.score(pa.array([t]))[0][0] for t in texts]
    assert np.round(alone, 6).tolist() == np.round(got, 6).tolist()  # whatever else is scored


def test_held_out_toxicity_of_a_small_table(spark):
    """A thousand documents, of which about fifty are labelled toxic."""
    from loomlog.llm import queries

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op4_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    caught, toxic, flagged = (sum(1 for r in got if f(r)) for f in (lambda r: r.predicted and r.toxic, lambda r: r.toxic, lambda r: r.predicted))
    assert toxic >= 5 and caught >= 0.5 * toxic and flagged - caught <= 0.06 * len(got)


def test_windows_cover_all_words():
    tokens = toxicity.tokenize(pa.array(["a " * n for n in (0, 1, 31, 32, 33, 48, 49, 200)]))
    doc, begin, size = toxicity.windows(tokens)
    first = np.cumsum(tokens.counts()) - tokens.counts()
    for d, n in enumerate(tokens.counts()):
        mine = [(b - first[d], b - first[d] + s) for b, s in zip(begin[doc == d], size[doc == d], strict=True)]
        assert {i for a, b in mine for i in range(a, b)} == set(range(n)) and len(set(mine)) == len(mine)


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (7, 0), (8, 0), (11, 1), (None, 1)], "doc_id long, toxic int")
    net = toxicity.fit(edge, labels)
    got = toxicity.score_texts(edge, net)
    assert got.count() == edge.count() and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert got.filter("doc_id IN (2, 3)").select("score").distinct().count() == 1
    same = [r.score for r in got.filter("doc_id IN (1, 12) AND text IS NOT NULL").collect()]
    assert len(same) == 4 and len(set(same)) == 1
    assert toxicity.score_texts(empty, net).count() == 0
    none = toxicity.fit(edge, labels.limit(0))
    assert toxicity.score_texts(edge, none).select("score").distinct().collect() == [(0.0,)]


def test_held_out_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.fit(docs.filter(~held))
    got = language.predict(docs.filter(held), model)
    assert got.filter("lang_pred = lang").count() >= 0.97 * got.count()


def test_mixtures_are_found():
    rng = random.Random(6)
    sets = {"aa": "ana tona lema", "bb": "krz szcz pwt", "cc": "ooi uue iaa"}
    counts = {}
    for lang, w in sets.items():
        tokens, which, inverse = language.distinct_words(pa.array([" ".join(rng.choice(w.split()) for _ in range(2000))]))
        owner, bucket = language.ngrams(tokens, which)
        counts[lang] = np.bincount(bucket, np.bincount(inverse)[owner], language.BUCKETS) + 0.5
    model = language.Model(list(sets), np.stack([np.log(c / c.sum()) for c in counts.values()]).astype(np.float32))
    mixed = " ".join([rng.choice(sets["aa"].split()) for _ in range(60)] + [rng.choice(sets["bb"].split()) for _ in range(20)])
    pi = language.infer(model, pa.array([mixed, "ooi uue ooi iaa", "", "123"]))
    assert pi[0] == pytest.approx([0.75, 0.25, 0], abs=0.05) and pi[0][2] == 0
    assert list(pi[1]) == [0, 0, 1] and not pi[2:].any()


def test_language_edges(spark, edge, empty):
    model = language.fit(edge)
    got = {r.doc_id: r for r in language.predict(edge, model).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[10].lang_pred == "und" and got[2].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].lang_pred in ("en", "fr", "und")
    assert language.predict(empty, model).count() == 0
    nothing = language.fit(edge.filter("lang IS NULL"))
    assert language.predict(edge, nothing).select("lang_pred").distinct().collect() == [("und",)]
