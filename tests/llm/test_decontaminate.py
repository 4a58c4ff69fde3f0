import random
import re

from loomlog.llm import decontaminate
from pyspark.sql import functions as F

from .conftest import words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items, size=13):
    w, hit, found = split(text), set(), set()
    for item, body in items:
        b = split(body)
        n = min(size, len(b))
        for i in range(len(b) - n + 1 if b else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit.update(range(j, j + n))
                    found |= {item} if item is not None else set()
    return len(w), len(hit), sorted(map(str, found))


def fixture():
    rng = random.Random(5)
    items = [(i, words(rng, 20, 50)) for i in range(12)] + [(50, "Short ITEM, here"), (51, ""), (52, None), (None, "nameless item of words"), (3, words(rng, 15, 50))]
    docs = []
    for i in range(60):
        body = words(rng, rng.randrange(0, 120), 50)
        if i % 3 == 0:
            a = items[rng.randrange(12)][1].split(" ")
            cut = rng.randrange(0, 8)
            body += " -- " + ", ".join(x.upper() for x in a[cut : cut + rng.randrange(10, 20)]) + " == " + body[:50]
        if i % 7 == 0:
            body = "short item here. " + body + " nameless  item of WORDS éa"
        docs.append((i, body))
    return items, docs


def check(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.find_contamination(d, b, **options).collect():
        n, hit, found = brute(r.text, items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found), r.doc_id
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        assert sum(len(split(r.text[a:b])) for a, b in r.hit_spans) == hit
        for a, b in r.hit_spans:
            assert split(r.text[a:b]) and split(r.text[a]) and split(r.text[b - 1])


def test_against_brute_force(spark):
    items, docs = fixture()
    check(spark, docs, items)


def test_several_automata_give_the_same(spark):
    items, docs = fixture()
    check(spark, docs[:25], items, max_memory=170_000)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, some = (sorted(decontaminate.find_contamination(d, b, max_memory=m).collect()) for m in (1 << 30, 170_000))
    assert one == some and decontaminate.part_count(decontaminate.windows(b), 170_000) > 1


def test_edges(spark, edge, empty):
    items = [(1, "one two three"), (2, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(edge, bench)
    assert got.count() == edge.count() and {"score", "lang"} <= set(got.columns)
    assert [r.doc_id for r in got.filter("contaminated").collect()] == [6]
    assert got.filter("text IS NULL").select("n_words", "n_hit").distinct().collect() == [(0, 0)]
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(edge, bench.limit(0)).filter(F.col("n_hit") > 0).count() == 0


def test_memory_bound_holds():
    """What an automaton takes stays under what its windows are counted as."""
    rng = random.Random(2)
    patterns = [(" ".join(f"word{rng.randrange(5000)}" for _ in range(13)), [str(i)]) for i in range(20_000)]
    machine = decontaminate.automaton(patterns)
    assert machine.get_stats()["total_size"] < decontaminate.NODE_BYTES * sum(len(w) + 2 for w, _ in patterns)
