"""Alignment against both libraries' own tokens and a plain walk over bytes."""

import random
from bisect import bisect_left
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from loomlog.llm import alignment, queries

P = pytest.importorskip("public_tokenizers")
FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_tokens():
    """text -> [(id, bytes)] of A and of B, by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in letters]
    byte_of = {chr(x): x for x in letters} | {chr(256 + i): x for i, x in enumerate(rest)}

    def tokens(text):
        out_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        return out_a, [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]

    return tokens


def plain(texts, tokens):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by loops over token ranges."""
    found = []
    for text in texts:
        a, b = tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            found.append(([], [], [], ""))
            continue
        ranges = []
        for side in (a, b):
            at, mine = 0, []
            for i, t in side:
                mine.append((i, at, at + len(t)))
                at += len(t)
            ranges.append(mine)
        links, j0 = [], 0
        for i, lo, hi in ranges[0]:
            while ranges[1][j0][2] <= lo:
                j0 += 1
            j = j0
            while j < len(ranges[1]) and ranges[1][j][1] < hi:
                links.append((i, ranges[1][j][0]))
                j += 1
        both = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
        sides = [{}, {}]
        for side, mine in zip(sides, ranges, strict=True):
            for i, _, e in mine:
                side.setdefault(bisect_left(both, e), []).append(str(i))
        found.append((a, b, links, ";".join(f"{','.join(sides[0][k])}|{','.join(sides[1][k])}" for k in range(len(both)))))
    counts = Counter(p for *_, links, _ in found for p in set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), g) for a, b, links, g in found]


ODD = [
    None, "", " ", "  two  spaces ", "a▁b", "<|endoftext|> is text", "<s> </s> <unk> <0x41>", "Straße über \U0001f600\U0001f680 日本語", "é ﬁ ①  nbsp　wide",
    "tabs\tand\nlines\r\n\n  ends", "\x00\x01\x1c\x1d\x85", "1234567890" * 30, "a" * 3000, "สวัสดี مرحبا", "don't we'll I'M", "​ zero‍width",
]


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    rows = alignment.align(docs, *FILES, P.PATTERN).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["__keep"].doc_id)], rows


def test_odd_texts_equal_plain_walk(spark, plain_tokens):
    rng = random.Random(2)
    mixed = ["".join(rng.choice("ab \né中\U0001f600.,1'") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    texts = [*ODD, *mixed, "the same text", "the same text", " ".join(f"w{rng.randrange(99)}" for _ in range(20_000))]
    got, _ = run(spark, texts)
    order = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert [tuple(g) for g in got] == plain(texts, plain_tokens), order


def test_query_equals_plain_walk(spark, sf_dir, plain_tokens):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *row[:6], sha256(row[6].encode()).hexdigest() if row[6] else "") for d, row in zip(docs, plain([d.text for d in docs], plain_tokens), strict=True))
    assert sorted(map(tuple, queries.op11_alignment(spark, sf_dir).collect())) == want


def test_groups_of_any_size_agree(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(2)
    row = lambda r: (r["__keep"].doc_id, *tuple(r)[1:])
    want = sorted(map(row, alignment.align(docs, *FILES, P.PATTERN, digest=True).collect()))
    monkeypatch.setattr(alignment, "GROUP_BYTES", 50_000)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 9_000)
    monkeypatch.setattr(alignment, "LANE", 1)
    assert sorted(map(row, alignment.align(docs, *FILES, P.PATTERN, digest=True).collect())) == want


def test_lanes_begin_where_both_end():
    rng = random.Random(1)
    for _ in range(200):
        ends = [np.array(sorted({*rng.sample(range(1, 60), rng.randrange(0, 30)), 60})) for _ in "ab"]
        begin = alignment.lanes(np.array([0]), *ends, every=rng.choice([1, 3, 8]))
        links_a, links_b, cuts_a, cuts_b = alignment.lockstep(*begin, *ends)
        lows = [np.append(0, e[:-1]) for e in ends]
        want = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if max(lows[0][i], lows[1][j]) < min(ends[0][i], ends[1][j])}
        assert set(zip(links_a.tolist(), links_b.tolist(), strict=True)) == want and len(links_a) == len(want)
        assert set(ends[0][cuts_a]) == set(ends[0]) & set(ends[1]) and (ends[0][cuts_a] == ends[1][cuts_b]).all()


def test_edge_rows(spark, edge, edge_rows, empty):
    got = alignment.align(edge, *FILES, P.PATTERN)
    rows = got.collect()
    assert len(rows) == len(edge_rows) and rows[0]["__keep"].asDict().keys() == set(edge.columns)
    assert [(r.n_a, r.groups) for r in rows if not r["__keep"].text] == [(0, "")] * 3
    assert alignment.align(empty, *FILES, P.PATTERN).count() == 0
