"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every merge rank has a bucket of places in a linked list of tokens; a bitmap in
three levels of 64-bit words says which buckets hold anything, and
find-first-set gives the lowest rank.  An entry is stale if its place was merged
away or its pair has another rank by now; stale entries are skipped.

Pre-tokens of up to ``LONG`` bytes, which is nearly all of a text, share one list
with walls between them, so one bucket is merged for all of them in a few numpy
steps.  Places of one rank are merged together, left to right without overlap.
That equals one merge at a time unless a merge can make a pair of lower rank;
ranks whose bytes stand inside a token of lower rank are therefore merged one
place a pre-token at a time.

A longer pre-token has a list of its own and is merged one place at a time, the
leftmost of the lowest rank: a bucket is a heap of places, so time grows with the
length times its logarithm, whatever the bytes are.

Defined results: null and empty texts have no ids and decode to no bytes;
repeated rows are encoded alike; nothing depends on other columns.
"""

from __future__ import annotations

import base64
import gc
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomlog.llm.batches import map_texts

#: Bytes of pre-tokens and ids, with what Python adds to each, that a worker remembers; emptied when full.
REMEMBERED, ENTRY_BYTES = 128 << 20, 160
#: Longer pre-tokens are merged alone and not remembered.
LONG = 256
#: UTF-8 bytes encoded at once: more share the steps of a bucket.
SLICE_BYTES = 8 << 20


class RankQueue:
    """Buckets of places by rank, under a bitmap of three levels."""

    def __init__(self, n_ranks: int):
        self.levels = [[0] * (-(-n_ranks // 64**i)) for i in (1, 2, 3)]
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        """The bucket of a rank, marked as holding something."""
        if rank not in self.buckets:
            self.buckets[rank] = []
            at = rank
            for level in self.levels:
                level[at >> 6] |= 1 << (at & 63)
                at >>= 6
        return self.buckets[rank]

    def lowest(self) -> int | None:
        """The lowest rank that holds anything."""
        at = 0
        for level in reversed(self.levels):
            for word in range(at, len(level)) if level is self.levels[-1] else (at,):
                if level[word]:
                    break
            else:
                return None
            bits = level[word]
            at = word << 6 | ((bits & -bits).bit_length() - 1)
        return at

    def empty(self, rank: int) -> list:
        """Takes the whole bucket of a rank."""
        at = rank
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        return self.buckets.pop(rank)

    def push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Adds places, in any order; ranks below 0 are left out."""
        real = ranks >= 0
        ranks, places = ranks[real], places[real]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        for rank, lo, hi in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:]):
            self.bucket(rank).append(places[lo:hi])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank that holds anything, and its places in order."""
        rank = self.lowest()
        if rank is None:
            return None
        held = self.empty(rank)
        return rank, np.sort(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])


class Codec:
    """Encoder and decoder for one rank table (token bytes -> id) and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.n = ranks, max(ranks.values()) + 1
        self.find = regex.compile(pattern).findall
        tokens = dict(zip(ranks.values(), ranks))
        in_order = [tokens.get(i, b"") for i in range(self.n)]
        self.joined, self.sizes = np.frombuffer(b"".join(in_order), np.uint8), np.array([*map(len, in_order)])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((ranks[t[:i]] * self.n + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pair_keys = np.array([*[k for k, _ in pairs], 2**62], np.int64)
        self.pair_ranks = np.array([*[r for _, r in pairs], -1], np.int64)
        self.careful = np.zeros(self.n, bool)
        for t, r in ranks.items():
            for i in range(len(t)):
                for j in range(i + 2, len(t) + 1):
                    if ranks.get(t[i:j], -1) > r:
                        self.careful[ranks[t[i:j]]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes in known, about
        self._rank_of: dict[int, int] | None = None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair of ids; -1 where they don't merge (ids of -1: a wall)."""
        keys = np.where((left < 0) | (right < 0), -1, left * self.n + right)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of each pre-token (32 bits each); a pre-token holds one byte at least."""
        lengths = np.array([len(t) + 1 for t in tokens])
        data = np.frombuffer(b"\0".join(tokens) + b"\0", np.uint8)
        ids = self.single[data]
        walls = np.cumsum(lengths) - 1
        ids[walls] = -1
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, -1)
        rank[:-1] = self.rank(ids[:-1], ids[1:])
        queue = RankQueue(self.n)
        queue.push(rank, np.arange(n))
        while top := queue.pop():
            r, places = top
            places = places[rank[places] == r]  # the others are stale
            if len(places) > 1:
                fresh = np.ones(len(places), bool)
                np.not_equal(places[1:], places[:-1], out=fresh[1:])
                places = places[fresh]
                if self.careful[r]:
                    owner = np.searchsorted(walls, places)
                    first = np.ones(len(places), bool)
                    np.not_equal(owner[1:], owner[:-1], out=first[1:])
                    rest, places = places[~first], places[first]
                    queue.push(np.full(len(rest), r), rest)
                else:
                    head = np.ones(len(places), bool)
                    np.not_equal(places[1:], after[places[:-1]], out=head[1:])
                    start = np.flatnonzero(head)
                    nth = np.arange(len(places)) - np.repeat(start, np.diff(np.append(start, len(places))))
                    places = places[nth % 2 == 0]
            if not len(places):
                continue
            gone = after[places]
            ids[places], ids[gone] = r, -2
            rank[gone] = -1
            follow = after[gone]
            after[places] = follow
            before[follow] = places  # a wall follows each pre-token
            rank[places] = self.rank(ids[places], ids[follow])
            queue.push(rank[places], places)
            prior = before[places]
            prior = prior[prior >= 0]
            rank[prior] = self.rank(ids[prior], ids[after[prior]])
            queue.push(rank[prior], prior)
        left = ids != -2
        ids = ids[left]
        ends = np.flatnonzero(ids == -1)
        flat, ends = ids.astype(np.int32).tobytes(), (4 * ends).tolist()
        return [flat[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends)]

    def merge_long(self, token: bytes) -> bytes:
        """The ids of one pre-token (32 bits each), one merge at a time."""
        if self._rank_of is None:
            self._rank_of = dict(zip(self.pair_keys[:-1].tolist(), self.pair_ranks[:-1].tolist(), strict=True))
        rank_of, n, end = self._rank_of.get, self.n, len(token)
        ids = self.single[np.frombuffer(token, np.uint8)].tolist()
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        rank = [rank_of(a * n + b, -1) for a, b in zip(ids, ids[1:])] + [-1]
        queue = RankQueue(n)
        for place, r in enumerate(rank):
            if r >= 0:
                queue.bucket(r).append(place)  # in order, which is a heap
        while (r := queue.lowest()) is not None:
            places, least = queue.buckets[r], r
            while places and least >= r:
                place = heappop(places)
                if rank[place] != r:
                    continue  # stale
                gone = after[place]
                follow, prior = after[gone], before[place]
                ids[place], ids[gone], rank[gone], after[place] = r, -1, -1, follow
                rank[place] = -1
                if follow < end:
                    before[follow] = place
                    rank[place] = rank_of(r * n + ids[follow], -1)
                if prior >= 0:
                    rank[prior] = rank_of(ids[prior] * n + r, -1)
                for p in (place, prior):
                    if p >= 0 and rank[p] >= 0:
                        heappush(queue.bucket(rank[p]), p)
                        least = min(least, rank[p])
            if not places:
                queue.empty(r)
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end among them: one place more than texts)."""
        collecting = gc.isenabled()
        gc.disable()  # millions of small objects without cycles
        try:
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            known, out, long = self.known, [], {}
            split = [self.find(t) for t in texts]
            new = []
            for t in set(chain.from_iterable(split)) - known.keys():
                data = t.encode("utf-8", "surrogatepass")
                if len(data) > LONG:
                    long[t] = self.merge_long(data)
                else:
                    new.append((t, data))
            for lo in range(0, len(new), 200_000):
                part = new[lo : lo + 200_000]
                merged = self.merge([data for _, data in part])
                known.update(zip((t for t, _ in part), merged, strict=True))
                self.held += sum(len(data) + ENTRY_BYTES for _, data in part) + sum(map(len, merged))
            while split:
                tokens = split.pop()
                out.append(b"".join([known[t] if t in known else long[t] for t in tokens] if long else map(known.__getitem__, tokens)))
        finally:
            if collecting:
                gc.enable()
        out.reverse()
        ends = np.cumsum([0, *map(len, out)]) // 4
        return np.frombuffer(b"".join(out), np.int32), ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, where each text's begin and end), for what ``encode`` gives."""
        sizes = self.sizes[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.begins[ids] - upto[:-1], sizes) + np.arange(upto[-1])
        return self.joined[source], upto[ends]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process; the vocabulary is installed beside the library on every machine."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def binaries(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DECODED = T.StructField("decoded", T.BinaryType())


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """``docs`` (columns ``keep``; default all) with ids, and with ``decode`` the bytes these decode to."""

    def make():
        held = codec(path, pattern)

        def fn(texts: pa.Array) -> list[pa.Array]:
            flat, ends = held.encode(texts.to_pylist())
            out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            return [*out, binaries(*held.decode(flat, ends))] if decode else out

        return fn

    return map_texts(docs, [IDS, DECODED] if decode else [IDS], make, text, keep, SLICE_BYTES)


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the bytes that the ids decode to (null ids: null)."""
    schema = T.StructType([*[f for f in encoded.schema if f.name != "decoded"], DECODED])
    names = [f.name for f in schema][:-1]

    def run(batches):
        held = codec(path, pattern)
        for batch in batches:
            lists = batch.column(names.index(ids))
            flat, counts = lists.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            data, at = held.decode(flat.astype(np.int64), np.concatenate([[0], np.cumsum(counts)]))
            got = pa.compute.if_else(lists.is_valid(), binaries(data, at), None)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], got], names=schema.names)

    return encoded.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)
