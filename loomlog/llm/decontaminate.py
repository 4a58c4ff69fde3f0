"""Benchmark decontamination by one Aho-Corasick automaton.

Benchmark items are cut into windows of ``window`` consecutive normalised words
(an item of fewer words, but some, is one window).  All windows go into one
automaton, and each document's normalised text is scanned once.  Normalised:
A-Z in lower case, words are maximal runs of digits, a-z and non-ASCII
characters, one space between words.  Match ends are turned into word places,
and these into code-point offsets of the original text.

Defined results: null and wordless texts have no words and no hits; repeated
documents each get their own row; an item with a null id marks words but is not
listed; an empty benchmark leaves every document clean.

The automaton is held by every Python worker, so its size is bounded: by nodes, one a
byte of a window at most, of NODE_BYTES each.  A benchmark that needs more than
``max_memory`` is dealt to several automata; each is one more scan, cut before the
next, that adds to what the others found.  A worker process builds an automaton once
and holds one at a time.  Results are the same, nothing is dropped.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.batches import cut, fresh, map_texts
from loomlog.llm.words import WORD

#: Normalised bytes by byte: words stay, A-Z in lower case; all else is a space.
TABLE = bytes((b + 0x20 if 0x41 <= b <= 0x5A else b) if WORD[b] else 0x20 for b in range(256))

WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', 0)"

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)

#: Memory of a node: 32 bytes, its link 8, and a share of values and lists (measured: 43.5 bytes of a process a byte of window).
NODE_BYTES = 44

HITS_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.list_(pa.int32()))), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def windows(items: DataFrame, window: int = 13, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of all items: (window, items: sorted ids as strings)."""
    words = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).select("item", F.expr(WORDS).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (
        words.filter(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, window), " "))).alias("window"))
        .groupBy("window")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def part_count(found: DataFrame, max_memory: int) -> int:
    """How many automata of at most about ``max_memory`` bytes the windows need, counted before any is fetched."""
    nodes = found.agg(F.coalesce(F.sum(F.octet_length("window") + 2), F.lit(0))).first()[0]
    return max(1, -(-nodes * NODE_BYTES // max_memory))


def automaton(patterns: list[tuple[str, list[str]]]) -> ahocorasick.Automaton | None:
    """Over bytes taken as Latin-1, each pattern between spaces; None without patterns."""
    if not patterns:
        return None
    out = ahocorasick.Automaton()
    for window, items in patterns:
        out.add_word(f" {window} ".encode().decode("latin-1"), (window.count(" ") + 1, items))
    out.make_automaton()
    return out


_held: dict[str, ahocorasick.Automaton | None] = {}


def held(sent: Broadcast, name: str) -> ahocorasick.Automaton | None:
    """The automaton of what was sent, built once a worker process; it takes the place of another."""
    if name not in _held:
        _held.clear()
        _held[name] = automaton(sent.value)
    return _held[name]


def merged(runs: list[list[int]]) -> list[list[int]]:
    """Runs [first, end) in order, those that meet or overlap as one."""
    out: list[list[int]] = []
    for begin, end in sorted(runs):
        if out and out[-1][1] >= begin:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def scan(found: ahocorasick.Automaton | None, text: str, before: dict | None = None) -> dict:
    """n_words, runs of hit words [first, end), their code-point spans and items of one text.

    ``before``: what other automata have found in it, which is added.
    """
    words = normalised(text)
    runs, items = ([list(r) for r in before["runs"]], set(before["items"])) if before else ([], set())
    if words and found is not None:
        plain = b" ".join(words).decode("latin-1")
        at = word = 0
        last: dict[int, int] = {}
        for end, (n, ids) in found.iter(f" {plain} "):
            word += plain.count(" ", at, end - 1)  # the match ends with the space after its last word
            at = end - 1
            last[word + 1] = max(n, last.get(word + 1, 0))
            items.update(ids)
        runs = merged(runs + [[end - n, end] for end, n in last.items()])
    return {"n_words": len(words), "runs": runs, "spans": spans(text, runs) if runs else [], "items": sorted(items)}


def spans(text: str, runs: list[list[int]]) -> list[list[int]]:
    """Code-point offsets, end exclusive, of runs of words."""
    bounds, inside = [], False
    for i, c in enumerate(text):
        is_word = ord(c) >= 0x80 or WORD[ord(c)]
        if is_word and not inside:
            bounds.append(i)
        elif not is_word and inside:
            bounds.append(i)
        inside = is_word
    if inside:
        bounds.append(len(text))
    return [[bounds[2 * a], bounds[2 * b - 1]] for a, b in runs]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_memory: int = 512 << 20, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``; default all) with n_words, n_hit, hit_spans, items and contaminated.

    hit_spans: [start, end) code points of the original text of each run of hit
    words.  contaminated: some word is hit, and at least one in twenty.
    """
    context = docs.sparkSession.sparkContext
    clash = {"n_words", "n_hit", "hit_spans", "items", "contaminated"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in clash or c == text]
    found = windows(benchmark, window)
    n = part_count(found, max_memory)
    dealt = found.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(n))) if n == 1 else cut(found.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(n))))
    out, before = docs, None
    for p in range(n):  # one part at a time is on the driver
        sent = context.broadcast(sorted((r.window, r["items"]) for r in dealt.filter(F.col("part") == p).collect()))

        def make(sent=sent, name=uuid.uuid4().hex):
            machine = held(sent, name)

            def fn(texts: pa.Array, before: pa.Array | None = None) -> list[pa.Array]:
                known = before.to_pylist() if before is not None else [None] * len(texts)
                return [pa.array([scan(machine, t, b) for t, b in zip(texts.to_pylist(), known, strict=True)], HITS_ARROW)]

            return fn

        hits = fresh([*docs.columns, *kept], f"__hits{p}")
        columns = [*dict.fromkeys([*kept, *([before] if before else []), *([text] if p < n - 1 else [])])]
        out = map_texts(out, [T.StructField(hits, HITS)], make, text, columns, beside=before)
        out = cut(out) if p < n - 1 else out
        before = hits
    hit = F.col(f"`{before}`")
    n_hit = F.aggregate(hit["runs"], F.lit(0).cast("long"), lambda a, r: a + (r[1] - r[0])).alias("n_hit")
    out = out.select(*[F.col(f"`{c}`") for c in kept], hit["n_words"].alias("n_words"), n_hit, hit["spans"].alias("hit_spans"), hit["items"].alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
