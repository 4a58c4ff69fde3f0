"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are equal) of
``max(least, 2 q)`` words or more that no neighbouring word extends.

Periods under SHORT come from direct scans: for each lag, stretches where a word
equals the one a lag before.  Longer periods come by scales: scale S, doubling
from SHORT, is for periods S to 2 S - 1.  A gram is of k = 2 S / 3 words, a window
of S words; a gram that is the least (by hash) of some window is selected.  In a
run of such a period a window and its copy a period later both lie inside, select
alike, and so seed the run: a pair of equal selected grams a period apart.
Seeds are extended both ways by hash, and every stretch is checked word by word.

In a region of short period d (k/2 at most) one gram comes again every d words,
and pairing all of them would be quadratic.  Such a region is a run R of a smaller
scale.  Its copy a period later is another run R', as the longer run would else
have the shorter period.  Either both end, or both begin, inside the long run: then
the gram's last, or first, occurrences in R and R' are a period apart, and stand
for all.  Or R and R' touch in the long run's middle: then every lag in phase up
to their lengths is tried, and runs of all these lags exist if R and R' are as
long, so this too is in proportion to the result.

Many documents are worked on at once: one array of word numbers with a value of
its own between documents, sorted so that those long enough for a scale come
first.  Time grows with the words, times the scales of the longest document.

Defined results: null and empty texts have no words and no runs; repeated rows
have equal results; nothing depends on other columns; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomlog.llm.batches import map_texts
from loomlog.llm.words import U, mix, powers

#: Fewest words of a run; periods below SHORT are scanned lag by lag (a multiple of 3).
LEAST, SHORT = 12, 24


class Words:
    """Word numbers of several documents in one array, with hashes of any range.

    ``x``: numbers, in each document after a value that stands nowhere else;
    ``starts``, ``sizes``: each document's first word and words.
    """

    def __init__(self, lists: Sequence[np.ndarray]):
        self.sizes = np.array([len(a) for a in lists], np.int64)
        walls = -1 - np.arange(len(lists) + 1)
        parts = [np.concatenate([walls[i : i + 1], a]) for i, a in enumerate(lists)]
        self.x = np.concatenate([*parts, walls[-1:]]).astype(np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes
        up, self.down = powers(len(self.x) + 1)
        self.sums = np.zeros(len(self.x) + 1, U)
        np.cumsum(mix(self.x.astype(U) + U(0x9E3779B97F4A7C15)) * up[: len(self.x)], out=self.sums[1:])

    def hashed(self, at: np.ndarray, n) -> np.ndarray:
        """Of the ``n`` words from each place; equal words, equal hash."""
        return (self.sums[at + n] - self.sums[at]) * self.down[at]


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of maximal stretches of true values."""
    edge = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def _sliding(values: np.ndarray, n: int, least: bool) -> np.ndarray:
    """The least (or greatest) of each ``n`` neighbours, by doubling widths."""
    fn, width = np.minimum if least else np.maximum, 1
    while 2 * width <= n:
        values = fn(values[:-width], values[width:])
        width *= 2
    return fn(values[: len(values) - (n - width)], values[n - width :]) if width < n else values


def _extend(words: Words, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretch around each place where words equal those ``lag`` later; ``end`` counts the lag in.

    A place whose own word differs has an empty stretch.
    """
    n = len(words.x)
    ahead, back = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for step in 1 << np.arange(int(n).bit_length())[::-1]:
        tried = ahead + step
        fits = at + lag + tried <= n
        tried = np.where(fits, tried, 0)
        same = fits & (words.hashed(at, tried) == words.hashed(at + lag, tried))
        ahead[same] = tried[same]
        tried = back + step
        fits = at - tried >= 0
        tried = np.where(fits, tried, 0)
        same = fits & (words.hashed(at - tried, tried) == words.hashed(at + lag - tried, tried))
        back[same] = tried[same]
    return at - back, at + ahead + lag


def _checked(words: Words, start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of the given stretches, compared word by word; one that a hash wrongly joined is split anew."""
    out = []
    for s, e, q in zip(start.tolist(), end.tolist(), lag.tolist(), strict=True):
        if np.array_equal(words.x[s : e - q], words.x[s + q : e]):
            out.append((s, e, q))
        else:
            lo, hi = _stretches(words.x[s : e - q] == words.x[s + q : e])
            out += [(s + a, s + b + q, q) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    return out


def _pairs(key: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, later place) of all equal keys whose distance is ``low`` or more and under ``high``."""
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    left, right, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    here = np.arange(len(at))
    while len(here := here[here + step < len(at)]):
        gap = at[here + step] - at[here]
        here = here[(key[here + step] == key[here]) & (gap < high)]
        far = here[at[here + step] - at[here] >= low]
        left.append(at[far])
        right.append(at[far + step])
        step += 1
    return np.concatenate(left), np.concatenate(right)


def _seeds(words: Words, scale: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of every run of period ``scale`` to 2 ``scale`` - 1, some of them several times.

    ``known``: [start, end, period] of all runs of shorter periods.
    """
    k = 2 * scale // 3
    grams = mix(words.hashed(np.arange(len(words.x) - k + 1), k))
    window = scale - k + 1
    if len(grams) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _sliding(grams, window, True)
    padded = np.concatenate([np.zeros(window - 1, U), least, np.zeros(window - 1, U)])
    at = np.flatnonzero(_sliding(padded, window, False) == grams)
    inner = known[(known[:, 2] <= k // 2) & (known[:, 1] - known[:, 0] >= k)]
    inner = inner[np.argsort(inner[:, 0], kind="stable")]
    if not len(inner):
        a, b = _pairs(grams[at], at, scale, 2 * scale)
        return a, b - a
    which = np.searchsorted(inner[:, 0], at, "right") - 1
    inside = (which >= 0) & (inner[which, 1] >= at + k)
    # occurrences inside a run of short period: the first and the last stand for all
    start, end, d = inner[which[inside]].T
    run, first = np.divmod(np.unique(which[inside] * len(words.x) + start + (at[inside] - start) % d), len(words.x))
    last = first + (inner[run, 1] - k - first) // inner[run, 2] * inner[run, 2]
    plain = at[~inside]
    both = [_pairs(grams[p], p, scale, 2 * scale) for p in (np.concatenate([plain, first]), np.concatenate([plain, last]))]
    places, lags = [p for p, _ in both], [r - p for p, r in both]
    # runs of one period and gram that touch: all lags in phase
    by = np.lexsort((inner[:, 0], inner[:, 2]))
    follows = np.full(len(inner), -1)
    touch = (inner[by[1:], 2] == inner[by[:-1], 2]) & (inner[by[1:], 0] <= inner[by[:-1], 1])
    follows[by[:-1][touch]] = by[1:][touch]
    at_gram = {(r, g): f for r, g, f in zip(run.tolist(), grams[first].tolist(), first.tolist(), strict=True)}
    for (r, g), f in at_gram.items():
        other = at_gram.get((int(follows[r]), g)) if follows[r] >= 0 else None
        if other is not None:
            d, most = int(inner[r, 2]), int(min(inner[r, 1] - inner[r, 0], inner[follows[r], 1] - inner[follows[r], 0]))
            lag = np.arange(scale + (other - f - scale) % d, min(2 * scale - 1, most) + 1, d)
            places.append(inner[r, 1] - lag)
            lags.append(lag)
    return np.concatenate(places), np.concatenate(lags)


def _distinct(runs: np.ndarray) -> np.ndarray:
    """Of equal stretches the one of the smallest period: the others are multiples of it."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.append(True, np.any(runs[1:, :2] != runs[:-1, :2], axis=1))] if len(runs) else runs


def find_runs(lists: Sequence[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each array of word numbers (0 or more) its runs: [start, length, period] by start, then period."""
    order = sorted(range(len(lists)), key=lambda i: -len(lists[i]))
    asked, least = least, min(least, LEAST)  # scales rely on all runs of a gram's length
    words = Words([lists[i] for i in order])
    x, found = words.x, [np.zeros((0, 3), np.int64)]
    for q in range(1, min(SHORT, len(x))):
        start, end = _stretches(x[q:] == x[:-q])
        some = end - start >= max(least - q, q)
        found.append(np.stack([start[some], end[some] + q, np.full(some.sum(), q)], 1))
    runs, scale = _distinct(np.concatenate(found)), SHORT
    while (many := int(np.searchsorted(-words.sizes, -2 * scale, "right"))) > 0:
        end = int(words.starts[many - 1] + words.sizes[many - 1]) + 1
        part = Words.__new__(Words)
        part.x, part.sums, part.down = x[:end], words.sums[: end + 1], words.down
        at, lag = _seeds(part, scale, runs[runs[:, 1] <= end])
        if len(at):
            lo, hi = _extend(part, at, lag)
            some = hi - lo >= np.maximum(least, 2 * lag)
            each = np.unique(np.stack([lo[some], hi[some], lag[some]], 1), axis=0)
            more = [r for r in _checked(part, *each.T) if r[1] - r[0] >= max(least, 2 * r[2])]
            runs = _distinct(np.concatenate([runs, np.array(more, np.int64).reshape(-1, 3)]))
        scale *= 2
    runs = runs[runs[:, 1] - runs[:, 0] >= asked]
    owner = np.searchsorted(words.starts, runs[:, 0], "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(lists) + 1))
    out: list[np.ndarray] = [runs[:0]] * len(lists)
    for place, i in enumerate(order):
        mine = runs[bounds[place] : bounds[place + 1]]
        mine = np.stack([mine[:, 0] - words.starts[place], mine[:, 1] - mine[:, 0], mine[:, 2]], 1)
        out[i] = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
    return out


def numbered(words: Sequence[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay if each run keeps its first period alone (and a word in several runs goes with any)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_runs", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()), T.StructField("runs", T.StringType()), T.StructField("collapsed", T.StringType()),
]


def _described(texts: pa.Array, digest: bool) -> list[pa.Array]:
    split = [t.encode().split() for t in texts.to_pylist()]  # at ASCII white space
    found = find_runs([numbered(w) for w in split])
    held: list[list] = [[] for _ in FIELDS]
    for words, runs in zip(split, found, strict=True):
        best = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist() if len(runs) else [None] * 3
        listed = "".join([f"{s},{n},{q}\n" for s, n, q in runs.tolist()])
        left = b" ".join(compress(words, kept_words(len(words), runs).tolist()) if len(runs) else words)
        both = [sha256(listed.encode()).hexdigest(), sha256(left).hexdigest()] if digest else [listed, left.decode()]
        for column, value in zip(held, [len(words), len(runs), *best, *both], strict=True):
            column.append(value)
    return [pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64()) for c, f in zip(held, FIELDS, strict=True)]


def periodic_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, digest: bool = False) -> DataFrame:
    """``docs`` (columns ``keep``; default all) with n_words, n_runs, the longest run, all runs, and the collapsed text.

    start, length, period: of the longest run (ties: smallest start, then period; null
    without runs).  runs: a line ``start,length,period`` for each.  collapsed: the
    words left, joined by spaces, if each run keeps only its first period.  With
    ``digest`` the last two are their SHA-256 in hex.
    """
    return map_texts(docs, FIELDS, lambda: lambda texts: _described(texts, digest), text, keep)
