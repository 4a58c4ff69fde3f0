"""Runs of words against a plain search over all lags, and the whole query against its contract in plain Python."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
from loomlog.llm import queries
from loomlog.llm.periodic import find_runs, periodic_runs


def plain_runs(w, least=12):
    """[(start, length, period)]: for each lag all stretches, the smallest lag of equal ones."""
    n, seen = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                seen.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digests = ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(runs), s, length, q, runs and 1000 * length // q or None, *(sha256(d.encode()).hexdigest() for d in digests))


def _texts(rng):
    """Word numbers of a shape that some step has to get right."""
    n, kind, w = rng.choice([0, 1, 11, 12, 13, 60, 200, 500]), rng.randrange(7), []
    if kind == 0:
        return [bin(i).count("1") & 1 for i in range(n)]  # no cubes
    if kind == 1:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]  # many nested runs
    if kind == 2:
        p = 1 + n // rng.randrange(2, 9)
        return [rng.random() if i < p else i - p for i in range(p)] * (n // p)
    while len(w) < n:
        if kind == 3:  # short periods that touch
            w += ([rng.randrange(2) for _ in range(rng.randrange(1, 4))] * 150)[: rng.randrange(1, 150)]
        elif kind == 4:  # long periods of one word and another
            w += ([0] * rng.randrange(1, 150) + [1]) * rng.randrange(1, 4)
        elif kind == 5:
            w += [rng.randrange(2) for _ in range(rng.randrange(1, 80))] * rng.randrange(1, 4)
        else:
            w.append(rng.randrange(2))
    return w[:n]


def test_all_runs_are_found():
    rng = random.Random(5)
    for _ in range(150):
        docs = [_texts(rng) for _ in range(rng.randrange(1, 7))]
        numbers = {v: i for i, v in enumerate(dict.fromkeys(v for d in docs for v in d))}
        for d, got in zip(docs, find_runs([np.array([numbers[v] for v in d], np.int64) for d in docs]), strict=True):
            assert [tuple(r) for r in got.tolist()] == plain_runs(d)


def test_least_length():
    w = [*range(100), *([100, 101] * 10), *range(102, 140)] + [7, 8, 9] * 30
    for least in (2, 12, 40):
        got = find_runs([np.array(w, np.int64)], least)[0].tolist()
        assert [tuple(r) for r in got] == [r for r in plain_runs(w, min(least, 12)) if r[1] >= least]


def test_long_periods_and_hot_words():
    """In time near linear: 200,000 words of one, of period 7,000, and without a cube."""
    one, long, none = np.zeros(200_000, np.int64), np.arange(200_000) % 7000, np.array([bin(i).count("1") & 1 for i in range(100_000)])
    got = find_runs([one, long, none])
    assert got[0].tolist() == [[0, 200_000, 1]] and got[1].tolist() == [[0, 200_000, 7000]] and (got[2][:, 1] < 4 * got[2][:, 2]).all()


def test_query_equals_plain_search(spark, sf_dir):
    got = sorted(map(tuple, queries.op12_periodic(spark, sf_dir).collect()))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fixed = [r for r in docs if len((r.text or "").split()) < 3000]  # the plain search is quadratic
    want = sorted(plain_row(r.doc_id, r.text) for r in fixed)
    ids = {r.doc_id for r in fixed}
    assert [r for r in got if r[0] in ids] == want and len(got) == len(docs)


def test_edge_rows(spark, edge, edge_rows, empty):
    got = periodic_runs(edge)
    assert "runs" in got.columns and set(edge.columns) <= set(got.columns)
    found = {(r.doc_id, r.text): r for r in got.collect()}
    assert len(got.collect()) == len(edge_rows) and periodic_runs(empty).count() == 0
    for row in found.values():
        if not row.text or not row.text.strip():
            assert (row.n_words, row.n_runs, row.start, row.runs, row.collapsed) == (0, 0, None, "", "")
    assert next(r for r in found.values() if r.doc_id == 10).collapsed == "1234567890"
