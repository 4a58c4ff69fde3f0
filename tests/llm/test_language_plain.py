"""The language query against expectation-maximisation in plain Python, from the hash of a gram to the dropped languages."""

import math
import re
import zlib
from collections import Counter
from functools import cache

from loomlog.llm import language, queries
from loomlog.llm.words import BASE

M = 2**64


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD % M
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 % M
    return x ^ x >> 33


@cache
def buckets(word):
    """The buckets of a word's grams of one to four bytes; those at its begin and end are grams of their own."""
    out = []
    for size in (1, 2, 3, 4):
        n = len(word) - size + 1
        for i in range(n):
            h = (sum((b + 1) * pow(BASE, j, M) for j, b in enumerate(word[i : i + size])) + size) % M
            h = (mixed(h) + (i == 0) * 0xA24BAED4963EE407 + (i == n - 1) * 0x9FB21C651E98DF25) % M
            out.append((mixed(h) >> 20) % language.BUCKETS)
    return out


def words(text):
    return re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def plain_model(rows):
    counts = {}
    for lang, text in rows:
        held = counts.setdefault(lang, Counter())
        for w in words(text):
            held.update(buckets(w))
    model = {}
    for lang in sorted(counts):
        total = sum(counts[lang].values()) + 0.5 * language.BUCKETS
        model[lang] = (lambda held, total: lambda b: math.log((held[b] + 0.5) / total))(counts[lang], total)
    return model


def plain_mixture(model, text):
    """Proportions by language, or None for a text without letters."""
    found = words(text)
    if not found or not model:
        return None
    names = list(model)
    logs = [[language.TEMPER * sum(model[n](b) for b in buckets(w)) for n in names] for w in found]
    likely = [[math.exp(v - max(row)) for v in row] for row in logs]

    def fitted(pi, times):
        for _ in range(times):
            new = [0.0] * len(names)
            for row in likely:
                joint = [a * b for a, b in zip(row, pi)]
                total = max(sum(joint), 1e-30)
                new = [x + j / total for x, j in zip(new, joint)]
            pi = [x / len(likely) for x in new]
        return pi, sum(math.log(max(sum(a * b for a, b in zip(row, pi)), 1e-30)) for row in likely)

    pi, fit = fitted([1 / len(names)] * len(names), language.ITERATIONS)
    for _ in range(len(names) - 1):
        least = min((p, i) for i, p in enumerate(pi) if p > 0)[1]
        trial = [0.0 if i == least else p for i, p in enumerate(pi)]
        trial, now = fitted([p / max(sum(trial), 1e-30) for p in trial], language.AGAIN)
        if now + language.PENALTY * math.log(len(found) + 1) < fit:
            break
        pi, fit = trial, now
    return dict(zip(names, pi))


def test_query_equals_plain_estimation(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    rest = lambda r: zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4
    model = plain_model([(r.lang, r.text) for r in docs if r.lang is not None and rest(r) != 2])
    got = {r.doc_id: r for r in queries.op6_language(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in docs:
        row = got[r.doc_id]
        if len(words(r.text)) > 4000:
            continue  # a plain loop over all words of the longest takes too long
        want = plain_mixture(model, r.text)
        if want is None or not re.search(r"[^\W\d_]", r.text or ""):
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        best = max(want.values())
        assert want[row.lang_pred] > best - 1e-3 and abs(row.score - best) < 2e-3, (r.doc_id, want, row)
        assert row.held_out == (rest(r) == 2)
