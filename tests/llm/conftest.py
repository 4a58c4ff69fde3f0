import random

import pytest

#: Columns whose names clash with what operators add.
EXTRA = "score double, kept string, n_words int, ids string, spans int, shard string, key int, log_weight string, __text int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank, tiny and very long texts, repeated rows, a null id, odd characters."""
    rng = random.Random(3)
    long = words(rng, 60_000)
    texts = [
        (1, words(rng, 120)), (2, None), (3, ""), (4, " \n\t "), (5, "One"), (6, "One two, three!"), (7, long), (8, words(rng, 80) + " é中🎉 # $ % ***"),
        (1, None), (9, "a" * 30_000), (None, "no id here but words enough to count"), (10, "1234567890 " * 50), (11, "Ça va bien, merci. Où est la bibliothèque?"),
    ]
    texts += [texts[0], texts[0], (12, texts[0][1])]
    return [(i, t, ("en", "fr", None)[k % 3], "s", None if t is None else len(t), 0.5, "x", 7, "y", 1, "z", 2, "q", 3) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
