"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding plus the mean embedding of its character
n-grams, both hashed.  Two gated recurrent units read a window of ``WINDOW``
words forwards and backwards, attention pools their states, and a logistic
output scores the window.  Windows overlap by half, all windows of a text are
scored, and the text's score is that of its highest window, put through a
logistic curve fitted on the training documents.

Labels are of documents, and a toxic document may be toxic in few places: the
first epochs train on all windows with their document's label, later ones on
each document's highest windows.  One dimension of the embeddings begins at how
much more often a feature stands in toxic training documents than in others, so
that a few dozen of them are enough to find the words that matter.  Training
takes a bounded sample of labelled documents (``MAX_ROWS`` of each label, none
longer than ``MAX_TRAIN_CHARS``).

Defined results: null, empty and wordless texts are one window without words;
equal texts score equally, whatever else is scored: matrix products are summed in
double precision and rounded, other sums go row by row, and scores have six
decimals; with only one label, or none, every score is the share
of toxic training rows (0 without rows).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.batches import map_texts
from loomlog.llm.words import U, WORD, pieces, tokenize

BUCKETS, DIM, HIDDEN = 1 << 15, 12, 8
SIZES = (3, 4, 5, 6)
WINDOW, STRIDE = 32, 16
#: Labelled documents of each label in training, at most, and characters of each.
MAX_ROWS, MAX_TRAIN_CHARS = 1500, 20_000
#: Windows scored at once.
BLOCK = 1024
#: First values of the embedding dimension that starts from counts: per unit of significance, at most.
START, MOST = 0.1, 6.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, summed in double precision and rounded: in which order doesn't show."""
    return (x.astype(np.float64) @ w.astype(np.float64)).astype(x.dtype)


def word_inputs(texts: pa.Array):
    """(tokens, each token's distinct word, CSR of its features: owner, bucket, weight)."""
    tokens = tokenize(texts, WORD)
    h = tokens.hashes()
    distinct, which, inverse = np.unique(h, return_index=True, return_inverse=True)
    owner, grams = pieces(tokens, which, SIZES)
    n = np.bincount(owner, minlength=len(which))
    own = np.arange(len(which))
    return tokens, inverse, np.concatenate([own, owner]), (np.concatenate([distinct, grams]) >> U(20)).astype(np.int64) % BUCKETS, np.concatenate([np.ones(len(which)), 1 / np.maximum(n, 1)[owner]]).astype(np.float32)


def windows(tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's place, first token, tokens) of every window; the last ones of a text end with it."""
    counts = tokens.counts()
    first = np.cumsum(counts) - counts
    n = np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1
    doc = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.minimum(nth * STRIDE, np.maximum(counts - WINDOW, 0)[doc])
    return doc, first[doc] + begin, np.minimum(counts[doc], WINDOW)


@dataclass
class Network:
    """All parameters by name: E embeddings; W, V, B input, state and bias of both units'
    gates (reset, update, candidate); A attention; O, o output; scale, shift of the score."""

    p: dict[str, np.ndarray]
    constant: float | None = None

    @staticmethod
    def fresh(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
        return Network(
            {
                "E": f(BUCKETS, DIM, by=0.1), "W": f(2, DIM, 3 * HIDDEN, by=DIM**-0.5), "V": f(2, HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), "B": np.zeros((2, 3 * HIDDEN), np.float32),
                "A": f(2 * HIDDEN, by=0.1), "O": f(2 * HIDDEN, by=HIDDEN**-0.5), "o": np.zeros(1, np.float32), "scale": np.ones(1, np.float32), "shift": np.zeros(1, np.float32),
            }
        )

    def embed(self, owner, bucket, weight, n) -> np.ndarray:
        e = self.p["E"]
        return np.stack([np.bincount(owner, weight * e[bucket, d], n) for d in range(DIM)], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """[2, n + 1, 3 HIDDEN]: what each word adds to both units' gates; the last one is no word."""
        out = np.stack([product(x, self.p["W"][d]) + self.p["B"][d] for d in range(2)])
        return np.concatenate([out, np.zeros((2, 1, out.shape[2]), np.float32)], 1)

    def forward(self, gates: np.ndarray, ids: np.ndarray, trace: list | None = None):
        """(logits, states, attention) of windows of word ids [windows, WINDOW]; -1: no word."""
        n, H = len(ids), HIDDEN
        real = ids >= 0
        states = np.zeros((n, WINDOW, 2 * H), np.float32)
        for d in range(2):
            h, V, G = np.zeros((n, H), np.float32), self.p["V"][d], gates[d]
            steps = []
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                g = G[ids[:, t]]
                rz = sigmoid(g[:, : 2 * H] + product(h, V[:, : 2 * H]))
                r, z = rz[:, :H], rz[:, H:]
                rh = r * h
                c = np.tanh(g[:, 2 * H :] + product(rh, V[:, 2 * H :]))
                z = z * real[:, t : t + 1]  # no word leaves the state alone
                new = h + z * (c - h)
                if trace is not None:
                    steps.append((t, h, r, z, rh, c, rz[:, H:]))
                h = new
                states[:, t, d * H : (d + 1) * H] = h
            if trace is not None:
                trace.append(steps)
        e = (states * self.p["A"]).sum(2) - np.where(real, np.float32(0), np.float32(30))
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", a, states)
        return (pooled * self.p["O"]).sum(1) + self.p["o"], states, a, pooled

    def gradients(self, x, ids, y, weight):
        """Of the weighted logistic loss, by parameter; that of the word inputs under ``x``."""
        trace: list = []
        H = HIDDEN
        logits, states, a, pooled = self.forward(self.gates(x), ids, trace)
        d_logit = ((sigmoid(logits) - y) * weight / len(y)).astype(np.float32)
        g = {"O": pooled.T @ d_logit, "o": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * self.p["O"]
        d_a = np.einsum("nh,nth->nt", d_pool, states)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        g["A"] = np.einsum("nt,nth->h", d_e, states)
        d_states = a[:, :, None] * d_pool[:, None, :] + d_e[:, :, None] * self.p["A"]
        d_gate_words = np.zeros((2, len(x) + 1, 3 * H), np.float32)
        g["V"], real = np.zeros_like(self.p["V"]), ids >= 0
        for d in range(2):
            V, d_h = self.p["V"][d], np.zeros((len(ids), H), np.float32)
            rows, values = [], []
            for t, h, r, z, rh, c, raw in reversed(trace[d]):
                d_h = d_h + d_states[:, t, d * H : (d + 1) * H]
                d_c = d_h * z * (1 - c * c)
                d_z = d_h * (c - h) * raw * (1 - raw) * real[:, t : t + 1]
                d_rh = d_c @ V[:, 2 * H :].T
                d_r = d_rh * h * r * (1 - r)
                d_g = np.concatenate([d_r, d_z, d_c], 1)
                g["V"][d][:, : 2 * H] += h.T @ d_g[:, : 2 * H]
                g["V"][d][:, 2 * H :] += rh.T @ d_c
                d_h = d_h * (1 - z) + d_rh * r + d_g[:, : 2 * H] @ V[:, : 2 * H].T
                rows.append(ids[:, t])
                values.append(d_g)
            rows, values = np.concatenate(rows), np.concatenate(values)
            for k in range(3 * H):
                d_gate_words[d, :, k] = np.bincount(np.where(rows < 0, len(x), rows), values[:, k], len(x) + 1)
        d_words = d_gate_words[:, :-1]
        g["B"] = d_words.sum(1)
        g["W"] = np.stack([x.T @ d_words[d] for d in range(2)])
        g["x"] = sum(d_words[d] @ self.p["W"][d].T for d in range(2))
        return g

    def score_windows(self, gates: np.ndarray, words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin), np.float32)
        for lo in range(0, len(begin), BLOCK):
            ids = window_ids(words, begin[lo : lo + BLOCK], size[lo : lo + BLOCK])
            out[lo : lo + BLOCK] = self.forward(gates, ids)[0]
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each text, windows, first word of its highest window)."""
        if self.constant is not None:
            return np.full(len(texts), self.constant), np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
        tokens, inverse, owner, bucket, weight = word_inputs(texts)
        doc, begin, size = windows(tokens)
        n_words = inverse.max() + 1 if len(inverse) else 0
        logits = self.score_windows(self.gates(self.embed(owner, bucket, weight, n_words)), inverse, begin, size)
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        top = np.maximum.reduceat(logits, first) if len(first) else np.zeros(0)
        order = np.lexsort((np.arange(len(doc)), -logits, doc))[first] if len(first) else first
        counts = tokens.counts()
        return sigmoid(self.p["scale"] * top.astype(np.float64) + self.p["shift"]), np.diff(np.append(first, len(doc))), begin[order] - (np.cumsum(counts) - counts)


def window_ids(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    step = np.arange(WINDOW)
    at = begin[:, None] + step
    inside = step < size[:, None]
    padded = words if len(words) else np.zeros(1, np.int64)
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)], -1)


def first_values(doc, begin, size, words, starts, n_words, bucket, labels, shown) -> np.ndarray:
    """Of each bucket, how significantly more often toxic documents have it: the log odds of
    document counts over their standard deviation, times START; 0 where nothing is known."""
    counts = np.zeros((2, BUCKETS))
    for i in np.flatnonzero(shown):
        mine = np.flatnonzero(doc == i) if len(doc) < 64 else np.arange(np.searchsorted(doc, i), np.searchsorted(doc, i, "right"))
        if len(mine):
            used = np.unique(words[begin[mine[0]] : begin[mine[-1]] + size[mine[-1]]])
            n = starts[used + 1] - starts[used]
            at = np.concatenate([used, n_words + np.repeat(starts[used] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            counts[int(labels[i] > 0), np.unique(bucket[at])] += 1
    total = np.array([(labels[shown] <= 0).sum(), (labels[shown] > 0).sum()])
    share = (counts.sum(0) + 0.5) / (total.sum() + 1)
    clean, toxic = counts[0] + total[0] * share * 0.1 + 0.1, counts[1] + total[1] * share * 0.1 + 0.1
    odds = np.log(toxic / (1.1 * total[1] + 0.2)) - np.log(clean / (1.1 * total[0] + 0.2))
    z = np.clip(odds / np.sqrt(1 / toxic + 1 / clean), -MOST, MOST)
    return np.where(counts.sum(0) > 0, START * z, 0).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, share: float | None = None, epochs: tuple[int, int] = (3, 8), batch: int = 128, rate: float = 0.02, decay: float = 0.02, seed: int = 5) -> Network:
    """Of documents with labels 0 and 1; ``share``: of label 1 where scores are to hold (default: as given).

    One document in five doesn't train the network but fits the score's curve.
    """
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Network({}, float(labels.mean()) if len(labels) else 0.0)
    rng, net = np.random.default_rng(seed), Network.fresh(seed)
    tokens, inverse, owner, bucket, weight = word_inputs(pa.array(texts, pa.string()))
    n_words = inverse.max() + 1
    starts = np.searchsorted(owner[n_words:], np.arange(n_words + 1)) if (np.diff(owner[n_words:]) >= 0).all() else None
    if starts is None:
        order = np.concatenate([np.arange(n_words), n_words + np.argsort(owner[n_words:], kind="stable")])
        owner, bucket, weight = owner[order], bucket[order], weight[order]
        starts = np.searchsorted(owner[n_words:], np.arange(n_words + 1))
    doc, begin, size = windows(tokens)
    aside = rng.random(len(texts)) < 0.2
    if len(set(labels[aside])) < 2 or len(set(labels[~aside])) < 2:
        aside[:] = False
    training = ~aside[doc]
    mean, square = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    steps = 0
    net.p["E"][:, 0] = first_values(doc, begin, size, inverse, starts, n_words, bucket, labels, ~aside)

    def learn(chosen: np.ndarray) -> None:
        nonlocal steps
        rng.shuffle(chosen)
        y = labels[doc[chosen]]
        share = max(float(y.mean()), 1e-3)
        for lo in range(0, len(chosen), batch):
            part = chosen[lo : lo + batch]
            ids = window_ids(inverse, begin[part], size[part])
            used, local = np.unique(ids[ids >= 0], return_inverse=True)
            if not len(used):
                continue
            small = np.full(ids.shape, -1)
            small[ids >= 0] = local
            n = starts[used + 1] - starts[used]
            at = np.concatenate([used, n_words + np.repeat(starts[used] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            own = np.concatenate([np.arange(len(used)), np.repeat(np.arange(len(used)), n)])
            b, w = bucket[at], weight[at]
            y = labels[doc[part]]
            g = net.gradients(net.embed(own, b, w, len(used)), small, y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)))
            gx = g.pop("x")
            g["E"] = np.stack([np.bincount(b, w * gx[own, d], BUCKETS) for d in range(DIM)], 1).astype(np.float32)
            steps += 1
            net.p["E"] *= 1 - decay
            for k, v in g.items():
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.01 * (v * v - square[k])
                net.p[k] -= rate * (mean[k] / (1 - 0.9**steps)) / (np.sqrt(square[k] / (1 - 0.99**steps)) + 1e-6)

    def logits() -> np.ndarray:
        return net.score_windows(net.gates(net.embed(owner, bucket, weight, n_words)), inverse, begin, size)

    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    per_doc = np.diff(np.append(first, len(doc)))
    for _ in range(epochs[0]):
        learn(np.flatnonzero(training))
    for _ in range(epochs[1]):
        now = logits()
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((-now, doc))] = np.arange(len(doc)) - np.repeat(first, per_doc)
        positive = labels[doc] > 0
        top = np.flatnonzero(training & positive & ((rank == 0) | ((now > 0) & (rank < 4))))
        hard = np.flatnonzero(training & ~positive & (rank < 2))
        easy = rng.choice(np.flatnonzero(training & ~positive), len(hard), replace=False)
        learn(np.concatenate([top, hard, easy]))
    judged = aside if aside.any() else np.ones(len(texts), bool)
    top, y = np.maximum.reduceat(logits(), first).astype(np.float64)[judged], labels[judged]
    share = y.mean() if share is None else min(max(share, 0.01), 0.99)
    balance = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    center, spread = top.mean(), top.std() + 1e-6
    x, scale, shift = (top - center) / spread, 1.0, 0.0
    for _ in range(500):  # a logistic curve over the highest windows: two parameters, plain descent
        err = (sigmoid(scale * x + shift) - y) * balance
        scale, shift = max(0.05, scale - 0.5 * float((err * x).mean())), shift - 0.5 * float(err.mean())
    scale, shift = scale / spread, shift - scale * center / spread
    net.p["scale"], net.p["shift"] = np.array([scale], np.float32), np.array([shift], np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> Network:
    """From the texts of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): the first
    ``max_rows`` rows of each label by hash of doc_id, and the share of toxic labels among all."""
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    share = labels.agg(F.avg("toxic")).first()[0]
    few = [labels.filter(F.col("toxic") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for label in (0, 1)]
    chosen = docs.select("doc_id", "text").filter(F.length("text") <= max_chars).join(F.broadcast(few[0].unionByName(few[1])), "doc_id")  # 2 max_rows at most
    sample = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "toxic").limit(2 * max_rows).collect()
    return train([r.text for r in sample], np.array([r.toxic for r in sample], np.float32), share)


def score_texts(docs: DataFrame, network: Network, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` (columns ``keep``; default all) with score, n_windows and top_word, the place of the highest window's first word."""
    sent = docs.sparkSession.sparkContext.broadcast(network)  # fixed size: BUCKETS x DIM floats and little else
    fields = [T.StructField("score", T.DoubleType()), T.StructField("n_windows", T.LongType()), T.StructField("top_word", T.LongType())]

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            score, n, at = sent.value.score(texts)
            return [pa.array(np.round(np.asarray(score, np.float64), 6)), pa.array(np.asarray(n, np.int64)), pa.array(np.asarray(at, np.int64))]

        return fn

    return map_texts(docs, fields, make, text, keep)
