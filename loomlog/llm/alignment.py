"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers' tokens cut the bytes of a space and the text.  Links are the pairs
of an A token and a B token whose byte ranges overlap; byte offsets where tokens of both
end cut the tokens into groups.

Lockstep merging: the documents of a slice are merged at once.  A NumPy state
holds each one's place among its A and its B tokens; a step emits a link for
each document, advances A, B or both by comparing where the two tokens end,
emits a cut where both end, and compacts the state when documents are finished.
Long documents enter as several lanes, each beginning at an offset where tokens of both end,
so that one long document does not leave the others waiting.

A tokens come from a byte-level BPE whose pre-tokens are remembered (``bpe.Codec``
over the vocabulary of the tokenizer's JSON file), B tokens from sentencepiece.

An id pair's count is the number of documents that hold it linked.  Documents are
dealt into groups of about GROUP_BYTES where they are read; a group lists its distinct
pairs with the number of its documents that have each, and keeps each document's
links as places in that list.  Pairs are added up over groups by a shuffle on the pair, the
highest count of each A id by a shuffle on the id (32,000 pairs an id at most, and
added up before), and the groups' pairs are answered by a join.  Neither
the table of pairs nor any group leaves the executors.

Defined results: null and empty texts, and texts whose joined tokens of A or B
differ from a space and the text (sentencepiece may normalise), have no tokens: all numbers
are 0 and groups is the empty string.  Repeated rows count as documents of their own.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomlog.llm.batches import bounded_batches, cut, drop, slices
from loomlog.llm.bpe import Codec

#: UTF-8 bytes merged at once, and of texts whose pairs are listed together.
SLICE_BYTES, GROUP_BYTES = 2 << 20, 16 << 20
#: A tokens between the beginnings of lanes, at least.
LANE = 256


class Pair:
    """Tokenizers A (a byte-level BPE's JSON file) and B (a sentencepiece model)."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece

        ranks = _byte_level(a_path)
        self.a = Codec(ranks, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_b = self.b.get_piece_size()
        self.tables = [_Table({i: t for t, i in ranks.items()}), _Table(dict(enumerate(map(self._piece, range(self.n_b)))))]

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For A and for B (ids, where each text's begin and end); texts that don't come back whole have none."""
        held = [t or "" for t in texts.to_pylist()]
        flat_a, at_a = self.a.encode([" " + t if t else "" for t in held])
        lists = self.b.encode(held, num_threads=1)
        at_b = np.cumsum([0, *map(len, lists)])
        flat_b = np.fromiter((i for ids in lists for i in ids), np.int32, at_b[-1])
        wanted = [(" " + t).encode() if t else b"" for t in held]
        want = np.frombuffer(b"".join(wanted), np.uint8)
        ends = np.cumsum([0, *map(len, wanted)])
        whole = np.ones(len(held), bool)
        for table, flat, at in ((self.tables[0], flat_a, at_a), (self.tables[1], flat_b, at_b)):
            upto = np.concatenate([[0], np.cumsum(table.sizes[flat])])
            if len(want) == upto[-1] and np.array_equal(upto[at], ends) and np.array_equal(table.join(flat), want):
                continue
            for i in np.flatnonzero(whole):
                whole[i] = table.join(flat[at[i] : at[i + 1]]).tobytes() == wanted[i]
        if not whole.all():
            (flat_a, at_a), (flat_b, at_b) = (_only(whole, flat, at) for flat, at in ((flat_a, at_a), (flat_b, at_b)))
        return [flat_a, flat_b], [at_a, at_b]


def _only(whole: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)
    return flat[np.repeat(whole, n)], np.concatenate([[0], np.cumsum(np.where(whole, n, 0))])


class _Table:
    """Bytes of each id, to join many ids at once."""

    def __init__(self, tokens: dict[int, bytes]):
        in_order = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.joined, self.sizes = np.frombuffer(b"".join(in_order), np.uint8), np.array([*map(len, in_order)], np.int32)
        self.begins = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)

    def join(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes, dtype=np.int32)
        return self.joined[np.repeat(self.begins[ids] - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)]


def _byte_level(path: str) -> dict[bytes, int]:
    """The ids of a byte-level BPE by their bytes; its merges must make ids in order, as ranks do."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = dict.fromkeys(printable)
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in letters)}
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = {t["content"] for t in held["added_tokens"]}
    ids = {bytes([byte_of[c] for c in token]): i for token, i in held["model"]["vocab"].items() if token not in special}
    made = [held["model"]["vocab"][m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in held["model"]["merges"]]
    if made != sorted(made):
        raise ValueError(f"{path}: merges do not make ids in order")
    return ids


def lanes(starts: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, every: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) where lanes begin: ``starts`` and, at least ``every`` A tokens later, offsets where tokens of both end."""
    place = np.searchsorted(ends_b, ends_a)
    common = np.flatnonzero(ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a)[:-1] + 1  # the token after
    strip = common // every
    common = common[np.flatnonzero(np.diff(strip, prepend=-1))]
    begin_a = np.unique(np.concatenate([starts, common]))
    return begin_a, np.where(begin_a > 0, place[begin_a - 1] + 1, 0)


def lockstep(begin_a: np.ndarray, begin_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merges all lanes at once: (A token, B token) of each link, lane by lane in order of steps, and of each cut.

    ``ends_a``, ``ends_b``: ascending byte offsets where tokens end; a lane goes on to the next one's beginning.
    """
    stop = np.append(begin_a[1:], len(ends_a))
    a, b, open_ = begin_a.copy(), begin_b.copy(), np.arange(len(begin_a))
    stop = stop.copy()
    links_a, links_b, cuts_a, cuts_b = ([np.zeros(0, np.int64)] for _ in range(4))
    while len(open_):
        links_a.append(a)
        links_b.append(b)
        end_a, end_b = ends_a[a], ends_b[b]
        both = end_a == end_b
        cuts_a.append(a[both])
        cuts_b.append(b[both])
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        going = a < stop
        if not going.all():
            a, b, stop, open_ = a[going], b[going], stop[going], open_[going]
    return tuple(np.concatenate(x) for x in (links_a, links_b, cuts_a, cuts_b))


def _written(ids: Sequence[np.ndarray], cuts: Sequence[np.ndarray], digits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """(bytes, where each group begins and ends) of all groups as ``a1,a2|b1;``."""
    n_a, n_b = len(ids[0]), len(ids[1])
    joined, begins, sizes = digits
    cut_a, cut_b = (np.sort(c) for c in cuts)
    per_a, per_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    # the A tokens of a group stand before its B tokens
    group_a, group_b = np.repeat(np.arange(len(cut_a)), per_a), np.repeat(np.arange(len(cut_b)), per_b)
    before_b = np.concatenate([[0], np.cumsum(per_b)])
    place_a, place_b = np.arange(n_a) + before_b[group_a], np.arange(n_b) + (cut_a + 1)[group_b]
    order = np.empty(n_a + n_b, np.int32)
    order[place_a], order[place_b] = ids
    size = sizes[order]
    upto = np.cumsum(size)
    out = joined[np.repeat(begins[order] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)].copy()
    out[upto[place_a[cut_a]] - 1] = ord("|")
    out[upto[place_b[cut_b]] - 1] = ord(";")
    return out.tobytes(), np.concatenate([[0], upto[place_b[cut_b]]])


class Aligner:
    """Aligns slices of texts; one for each worker process."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        self.pair = Pair(a_path, b_path, pattern)
        n = max(len(t.sizes) for t in self.pair.tables)
        text = [f"{i},".encode() for i in range(n)]
        sizes = np.array([*map(len, text)])
        self.digits = np.frombuffer(b"".join(text), np.uint8), np.cumsum(sizes) - sizes, sizes

    def align(self, texts: pa.Array, digest: bool) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray]:
        """([n_a, n_b, n_groups, n_links of each text], groups, (text's place, pair) of each link)."""
        ids, ats = self.pair.encode(texts)
        n, (n_a, n_b) = len(texts), (np.diff(at) for at in ats)
        if not len(ids[0]):
            zero = np.zeros(n, np.int64)
            return [n_a, n_b, zero, zero], [""] * n, zero[:0], zero[:0]
        ends = [np.cumsum(table.sizes[flat], dtype=np.int64) for table, flat in zip(self.pair.tables, ids, strict=True)]
        some = np.flatnonzero(n_a)
        links_a, links_b, *cuts = lockstep(*lanes(ats[0][some], *ends), *ends)
        owner = np.repeat(np.arange(n), n_a)
        n_links, n_groups = (np.bincount(owner[x], minlength=n) for x in (links_a, cuts[0]))
        text, at = _written(ids, cuts, self.digits)
        bounds = at[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
        parts = [text[lo : max(lo, hi - 1)] for lo, hi in zip(bounds, bounds[1:])]
        groups = [(sha256(p).hexdigest() if digest else p.decode()) if p else "" for p in parts]
        pairs = ids[0][links_a].astype(np.int64) * self.pair.n_b + ids[1][links_b]
        return [n_a, n_b, n_groups, n_links], groups, owner[links_a], pairs


_aligners: dict[tuple[str, str, str], Aligner] = {}


def aligner(*files: str) -> Aligner:
    if files not in _aligners:
        _aligners[files] = Aligner(*files)
    return _aligners[files]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes: those of small numbers compress to nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


class _Group:
    """Links of consecutive slices, until their pairs are listed."""

    def __init__(self):
        self.rows, self.size, self.docs, self.pairs, self.n = [], 0, [], [], 0

    def add(self, rows: pa.RecordBatch, docs: np.ndarray, pairs: np.ndarray, size: int) -> None:
        key = np.sort(docs * (1 << 40) + pairs)  # pairs are under 2^40; a group has far fewer than 2^23 texts
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(key)))
        key = key[new]
        self.docs.append(self.n + (key >> 40))
        self.pairs.append(np.stack([key & ((1 << 40) - 1), times]))
        self.rows.append(rows)
        self.n += rows.num_rows
        self.size += size

    def close(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(distinct pairs, documents that hold each, each document's packed links); frequent pairs come first."""
        docs, (pairs, times) = np.concatenate(self.docs), np.concatenate(self.pairs, axis=1)
        listed, place, held = np.unique(pairs, return_inverse=True, return_counts=True)
        rank = np.empty(len(listed), np.int64)
        order = np.argsort(-held, kind="stable")
        rank[order] = np.arange(len(listed))
        bounds = np.searchsorted(docs, np.arange(self.n + 1)).tolist()
        at, packed = rank[place], []
        for lo, hi in zip(bounds, bounds[1:]):
            mine = np.argsort(at[lo:hi], kind="stable") + lo
            packed.append(planes(np.concatenate([np.diff(at[mine], prepend=0), times[mine]])))
        return listed[order], held[order], packed


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text", keep: Sequence[str] | None = None, digest: bool = False) -> DataFrame:
    """``keep`` (default: all columns) as __keep, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    n_best: links whose pair's count is the highest of its A id; count_sum: sum of counts over links;
    groups: ``a1,a2|b1;a3|b2,b3`` or, with ``digest``, its SHA-256 in hex (the empty string without tokens).
    """
    bounded_batches(docs.sparkSession)
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("__keep")
    work = docs.select(kept, F.col(f"`{text}`").cast("string").alias("text"))
    long, binary = T.LongType(), T.BinaryType()
    fields = [T.StructField(c, long) for c in NUMBERS] + [T.StructField("groups", T.StringType()), T.StructField("links", binary)]
    listing = [T.StructField("group", long), T.StructField("pairs", T.ArrayType(long)), T.StructField("held", T.ArrayType(long))]
    keep_field = T.StructField("__keep", work.schema["__keep"].dataType)  # null in a listing's row
    schema = T.StructType([keep_field, *fields, *listing])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held = aligner(a_path, b_path, pattern)
        group, n_groups, task = _Group(), 0, TaskContext.get().partitionId()

        def flush():
            nonlocal group, n_groups
            pairs, counts, packed = group.close()
            number, n_groups, done = (task << 32) + n_groups, n_groups + 1, 0
            for rows in group.rows:
                n = rows.num_rows
                more = {"links": pa.array(packed[done : done + n], pa.binary()), "group": pa.array(np.full(n, number))}
                columns = dict(zip(rows.schema.names, rows.columns, strict=True)) | more
                yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)
                done += n
            columns = {"group": pa.array([number]), "pairs": pa.array([pairs], arrow.field("pairs").type), "held": pa.array([counts], arrow.field("held").type)}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(1, f.type)) for f in arrow], schema=arrow)
            group = _Group()

        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES):
                texts = batch.column(1).slice(lo, hi - lo).cast(pa.string())
                values, groups, at, pairs = held.align(texts, digest)
                columns = [batch.column(0).slice(lo, hi - lo), *[pa.array(v.astype(np.int64)) for v in values], pa.array(groups, pa.string())]
                rows = pa.RecordBatch.from_arrays(columns, names=["__keep", *NUMBERS, "groups"])
                group.add(rows, at, pairs, texts.nbytes)
                if group.size >= GROUP_BYTES:
                    yield from flush()
        if group.n:
            yield from flush()

    aligned = cut(work.mapInArrow(run, schema))
    asked = aligned.filter("pairs IS NOT NULL").select("group", F.posexplode(F.arrays_zip("pairs", "held"))).select("group", "pos", F.col("col.pairs").alias("pair"), F.col("col.held").alias("held"))
    n_b = aligner(a_path, b_path, pattern).pair.n_b
    counts = asked.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("a", F.floor(F.col("pair") / n_b))
    # an A id has n_b pairs at most, so a window never holds more
    best = cut(counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a"))).select("pair", "count", "best"))
    answers = asked.join(best, "pair").select(F.col("group").alias("asker"), "pos", "count", "best")
    rows = aligned.filter("pairs IS NULL").drop("pairs", "held")
    out = T.StructType([keep_field, *fields[:4], T.StructField("n_best", long), T.StructField("count_sum", long), fields[4]])
    arrow_out = to_arrow_schema(out)

    def look_up(mine, answered):
        order = np.argsort(answered.column("pos").to_numpy())
        count, is_best = answered.column("count").to_numpy()[order], answered.column("best").to_numpy()[order]
        n_best, total = [], []
        for packed in mine.column("links"):
            both = numbers(packed.as_py())
            at, times = np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]
            n_best.append(int(times[is_best[at]].sum()))
            total.append(int((times * count[at]).sum()))
        more = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table([more.get(f.name, mine.column(f.name) if f.name in mine.column_names else None) for f in arrow_out], schema=arrow_out)

    result = cut(rows.groupBy("group").cogroup(answers.groupBy("asker")).applyInArrow(look_up, out))
    drop(aligned, best)
    return result
