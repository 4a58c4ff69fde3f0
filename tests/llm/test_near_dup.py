import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from loomlog.llm import near_dup
from loomlog.llm.components import connected

from .conftest import words


def corpus():
    """Random texts, exact copies, near copies of several strengths, and a common passage."""
    rng = random.Random(11)
    base = [words(rng, 150, 5000).split(" ") for _ in range(60)]
    docs = [" ".join(b) for b in base]
    for b in base[:12]:
        for edits in (1, 2, 3, 5):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(c))
    docs += docs[:5] * 3
    passage = words(rng, 60, 5000)
    docs += [words(rng, 60, 5000) + "\n" + passage for _ in range(30)]
    docs += ["tiny text", "Tiny, text!", "tiny text", ""]
    return docs


def features(text):
    """A text's shingles and how often it has each, in plain Python."""
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_weights(docs):
    """Weighted shingles of each text, by document frequencies over the distinct texts."""
    each = {t: features(t) for t in set(docs)}
    df = Counter(s for f in each.values() for s in f)
    idf = {s: 1 + math.log(len(each) / n) / math.log(max(len(each), 2)) for s, n in df.items()}
    return [{s: n * idf[s] for s, n in each[t].items()} for t in docs]


def jaccard(a, b):
    least = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return least / (sum(a.values()) + sum(b.values()) - least) if a or b else 0


def brute_classes(docs, threshold=0.8):
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    weights = plain_weights(docs)
    for i in range(len(docs)):
        for j in range(i + 1, len(docs)):
            if docs[i] == docs[j] or jaccard(weights[i], weights[j]) >= threshold:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(docs))]


def test_classes_equal_brute_force(spark):
    docs = corpus()
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_dup.classify(d).collect()}
    assert [got[i] for i in range(len(docs))] == brute_classes(docs)
    kept = near_dup.one_of_each(d)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_links_have_their_similarity(spark):
    docs = corpus()
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    nodes, links = near_dup.near_duplicates(d)
    at = {r.node: r.doc_id for r in nodes.collect()}
    weights = plain_weights(docs)
    got = links.collect()
    assert len(got) > 20 and all(abs(r.similarity - jaccard(weights[at[r.a]], weights[at[r.b]])) < 1e-5 for r in got)


def test_frequencies_are_exact(spark, monkeypatch):
    """Over several groups and parts, each text gets the counts of its own shingles."""
    monkeypatch.setattr(near_dup, "GROUP_BYTES", 3000)
    monkeypatch.setattr(near_dup, "PART_BYTES", 7000)
    docs = sorted(set(corpus()))
    d = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(docs)], "node string, text string").repartition(5)
    signed, n = near_dup.signatures(d, 16, 3)
    df = Counter(s for t in docs for s in features(t))
    total = [sum(w.values()) for w in plain_weights(docs)]
    assert n == len(docs)
    for r in signed.collect():
        t = docs[int(r.node)]
        assert sorted(near_dup.unpack(r.df).tolist()) == sorted(df[s] for s in features(t))
        assert abs(r.total - total[int(r.node)]) < 1e-3 and (r.keys is None) == (not features(t))


def test_samples_agree_as_often_as_texts_are_alike():
    rng = random.Random(2)
    b = words(rng, 400, 10**6).split(" ")
    c = list(b)
    for i in range(0, 400, 40):
        c[i] = f"y{i}"
    texts = pa.array([" ".join(b), " ".join(c)])
    doc, h, times = near_dup.shingles(near_dup.tokenize(texts))
    for weight in (times.astype(np.float32), (1 + h % 7 / 3 + doc * (h % 2)).astype(np.float32)):
        s = near_dup.overlap(*[(np.zeros((doc == i).sum(), int), h[doc == i], weight[doc == i]) for i in (0, 1)], 1)[0]
        drawn = near_dup.draw(doc, h, weight, 2, 1000)
        assert abs((drawn[0] == drawn[1]).mean() - s) < 0.05


def test_edited_copies_are_found(spark):
    """Of pairs at the threshold or above, at least nine in ten share a class; clean texts are left alone."""
    rng = random.Random(21)
    docs = []
    for k in range(150):
        b = words(rng, rng.randrange(60, 400), 10**6).split(" ")
        docs.append(" ".join(b))
        for share in (0.005, 0.01, 0.02, 0.04):
            docs.append(" ".join(f"e{rng.randrange(10**9)}" if rng.random() < share else w for w in b))
    clean = [words(rng, rng.randrange(30, 200), 10**6) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(docs + clean)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dup.classify(d).collect()}
    weights = plain_weights(docs + clean)
    alike = [(i, j) for k in range(150) for i in range(5 * k, 5 * k + 5) for j in range(i + 1, 5 * k + 5) if jaccard(weights[i], weights[j]) >= 0.8]
    assert len(alike) > 300 and sum(got[i] == got[j] for i, j in alike) >= 0.99 * len(alike)
    assert all(got[i] == i for i in range(len(docs), len(docs) + 300))


def test_large_buckets_are_compared_whole(spark):
    """Hundreds of texts share a long passage but not each other's class, and hide one linked pair."""
    rng = random.Random(22)
    passage = words(rng, 120, 10**6)
    docs = [passage + " " + words(rng, rng.randrange(50, 90), 10**6) for _ in range(300)]
    b = docs[7].split(" ")
    docs.append(" ".join([*b[:-3], "p", "q", "r"]))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dup.classify(d).collect()}
    assert [got[i] for i in range(len(docs))] == brute_classes(docs)


def test_a_star_of_copies_is_one_class(spark):
    """Copies that resemble only the original are found through it, however many there are."""
    rng = random.Random(7)
    b = words(rng, 130, 10**6).split(" ")
    docs = [" ".join(b)]
    for _ in range(300):
        c = list(b)
        for _ in range(2):
            c[rng.randrange(len(c))] = f"z{rng.randrange(10**9)}"
        docs.append(" ".join(c))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    others = spark.createDataFrame([(1000 + i, words(rng, 50, 10**6)) for i in range(8000)], "doc_id long, text string")
    got = near_dup.classify(d.unionByName(others))
    assert got.filter("doc_id < 1000").select("class_id").distinct().count() == 1
    assert got.filter("doc_id >= 1000 AND class_id <> doc_id").count() == 0


def test_components_of_a_long_chain(spark):
    n = 12
    links = spark.createDataFrame([(f"{zlib.crc32(str(i).encode()):010d}", f"{zlib.crc32(str(i + 1).encode()):010d}") for i in range(n)], "a string, b string")
    assert connected(links).select("label").distinct().count() == 1


def test_edges(spark, edge, empty):
    got = near_dup.classify(edge)
    assert got.count() == edge.count()
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert all(r.class_id == 2 and r.kept for r in by_id[2])
    assert by_id[12][0].class_id == 1 and not by_id[12][0].kept
    one = near_dup.one_of_each(edge)
    assert one.columns == edge.columns
    texts = [r.text for r in one.collect()]
    assert texts.count(None) == 2 and len({t for t in texts if t is not None}) == len(texts) - 2
    assert near_dup.classify(empty).count() == 0 and near_dup.one_of_each(empty).count() == 0


def test_classes_without_own_ids_stay_apart(spark):
    """Different texts under null ids or under one id are classes of their own; so are their copies."""
    rng = random.Random(5)
    texts = [words(rng, 60, 10**6) for _ in range(6)]
    ids = [None, None, None, 7, 7, 8]
    rows = [*zip(ids, texts, strict=True), (None, texts[0]), (9, texts[3]), (None, texts[5])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in near_dup.one_of_each(d).collect()) == sorted(texts)
    got = near_dup.classify(d)
    assert got.select("class_node").distinct().count() == 6
    assert sorted(str(r.doc_id) for r in got.filter("kept").collect()) == ["7", "7", "8", "None", "None", "None", "None"]


def test_weights_tell_rare_from_common():
    """A passage in 3 % of the documents weighs less than what one document has alone."""
    rng = random.Random(9)
    passage = words(rng, 200, 10**6)
    docs = [words(rng, 40, 10**6) + "\n" + passage for _ in range(6)] + [words(rng, 30, 10**6) for _ in range(194)]
    plain = [Counter(features(t)) for t in docs[:2]]
    weights = plain_weights(docs)
    assert jaccard(*weights[:2]) < 0.68 < 0.7 < jaccard(*plain)
    h = np.array([1, 2, 3, 200])
    assert np.allclose(near_dup.idf_of(h, 200), 1 + np.log(200 / h) / np.log(200)) and near_dup.idf_of(np.array([1]), 1) == [1]


def test_pairs_are_linked_by_full_weights(spark, monkeypatch):
    """Copies that differ only in a passage of 13 % of the documents, over several groups and parts."""
    monkeypatch.setattr(near_dup, "GROUP_BYTES", 5000)
    monkeypatch.setattr(near_dup, "PART_BYTES", 5000)
    rng = random.Random(10)
    passage = words(rng, 27, 10**6)
    same = words(rng, 92, 10**6)
    docs = [same, same + "\n" + passage] + [words(rng, 30, 10**6) + "\n" + passage for _ in range(30)] + [words(rng, 60, 10**6) for _ in range(200)]
    assert jaccard(*[features(t) for t in docs[:2]]) < 0.78
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_dup.classify(d).collect()}
    assert got == {i: 0 if i < 2 else i for i in range(len(docs))} == dict(enumerate(brute_classes(docs)))


def test_texts_with_much_of_their_own_are_not_compared(spark, monkeypatch):
    """A large group around one text, each too far from all others by words of its own: none is left to be compared
    with all others, and two that are copies of each other are still found."""
    from loomlog.llm import near_dup

    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]

    def edited(i, words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"own{i}x{at}"
        return words

    texts = [edited(i, base, 5) for i in range(300)]
    texts.append(edited(999, texts[0], 1))
    left = []
    compare = near_dup._compare_blocks
    monkeypatch.setattr(near_dup, "_compare_blocks", lambda open_, *more: left.append(open_.count()) or compare(open_, *more))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    nodes, _ = near_dup.near_duplicates(docs)
    classes = {r.doc_id: r.class_id for r in nodes.collect()}
    assert classes == {i: i for i in range(300)} | {300: 0}
    assert sum(left) < 100
