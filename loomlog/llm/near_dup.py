"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

A text's features are its distinct shingles of five normalised words (a text of
one to four words has one shingle of all of them), weighted by occurrences
times idf.  idf(s) = 1 + ln(N / df(s)) / ln N over the N distinct texts: 2 for a
shingle of one text, 1 for a shingle of all.  Document frequencies are exact
counts over all texts, of every shingle.  They are added up by ranges of the
hash and go back to the texts; no table of shingles is sent to all.

The logarithm is scaled, and not taken as it is, because a large group of near
copies makes its own shingles common: by ln(N / df) alone copies with a few
changed words in a group of some per cent of all texts fall under the threshold.

1. Texts that are equal become one node (128 bits of SHA-256); all that follows
   is about nodes.
2. Each node gets ``bands * rows`` consistent weighted samples; a band of equal
   samples makes a bucket.
3. In each bucket, members are paired with two leaders, not with each other;
   pairs are verified by exact weighted Jaccard similarity, and links of
   ``threshold`` or more join nodes into classes.
4. Buckets whose members are still in different classes get another leader (the
   member with most links), as long as each round halves what is open.  At last
   the members outside a bucket's largest class are compared with all members of
   other classes, in blocks of BLOCK by BLOCK texts; a pair is compared in the
   first bucket it shares.  In buckets of several blocks texts are dealt by
   total weight, and only blocks whose weights allow the threshold meet.  Blocks
   hold texts, not pairs, and only links that join classes come out.  So no
   linked pair that shares a bucket is left apart.

What a text shares with any other is at most the weight of its shingles that more
than one text has.  So texts a and b can be a link only if each one's total weight is
within the other's ``reach``.  Members that reach no total weight of their bucket
leave it before anything is paired: most members of a large group of copies that
are too far from each other, each by words of its own.

Defined results: a null text is never a copy, its row is its own class; texts
without words are copies only of equal texts; repeated rows share their class;
the class id is the smallest doc_id in the class, null where all are null.
Classes may share it where doc_ids are repeated or null; class_node they don't.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomlog.llm.batches import bounded_batches, cut, drop, free_shuffles, slices
from loomlog.llm.components import connected
from loomlog.llm.words import U, mix, shingles, tokenize

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 3
#: Bytes of text that ask for document frequencies together, and whose shingles a part counts.
GROUP_BYTES, PART_BYTES = 2 << 20, 8 << 20
#: Above so many bytes both grow with the square root of the input, up to GROWN times, so that
#: what a group asks of a part stays many shingles a row.
STEADY_BYTES, GROWN = 10 << 30, 32
#: Shingles whose samples are drawn together: their arrays stay in cache.
DRAWN = 1 << 15
#: Texts on each side of a block.
BLOCK = 128


# --- document frequencies -------------------------------------------------
#
# Texts are dealt into groups of about GROUP_BYTES.  A group asks for its distinct
# shingles, cut by ranges of the hash into parts; a part adds up all groups' counts
# and answers each group in the order it asked.  What a group asks depends on its
# texts alone, so a task that runs again asks the same.

ASKED = T.StructType([T.StructField("group", T.LongType()), T.StructField("part", T.LongType()), T.StructField("shingles", T.BinaryType()), T.StructField("counts", T.BinaryType())])
ANSWER = T.StructType([T.StructField("group", T.LongType()), T.StructField("part", T.LongType()), T.StructField("df", T.BinaryType())])

ASKED_ARROW = to_arrow_schema(ASKED)


def pack(x: np.ndarray) -> bytes:
    """64-bit integers as eight planes of bytes: those of small numbers compress to nothing."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _shingled(texts: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, text's place, shingle, occurrences) of each slice."""
    return [(hi - lo, *shingles(tokenize(texts.slice(lo, hi - lo)), SHINGLE_WORDS)) for lo, hi in slices(texts)]


def _distinct(shingled: list) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all texts, texts that have each)."""
    return np.unique(np.concatenate([np.zeros(0, U), *[x[2] for x in shingled]]), return_counts=True)


def _totals(asked: pa.Table) -> list[np.ndarray]:
    """For each row of a part, the document frequencies of its shingles."""
    lists = [np.cumsum(unpack(x.as_py())) for x in asked.column("shingles")]
    found, place = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    places = np.split(place.ravel(), np.cumsum([len(x) for x in lists])[:-1])
    for at, counts in zip(places, asked.column("counts"), strict=True):
        total[at] += unpack(counts.as_py()).astype(np.int64)  # a row has no shingle twice
    return [total[at] for at in places]


def dealt(texts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(``texts`` (node, text) with their group, what groups ask, texts)."""
    n_texts, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    grown = min(GROWN, max(1.0, (size / STEADY_BYTES) ** 0.5))
    groups, parts = (int(1 + size // (most * grown)) for most in (GROUP_BYTES, PART_BYTES))
    placed = texts.select("node", "text", F.pmod(F.xxhash64("node"), F.lit(groups)).alias("group"))

    def ask(key, table):
        found, counts = _distinct(_shingled(table.column("text").combine_chunks()))
        part = (found >> U(20)) * U(parts) >> U(32)  # of the 52 bits the first 32
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(part))
        rows = [(key[0].as_py(), int(part[lo]), pack(np.diff(found[lo:hi], prepend=U(0))), pack(counts[lo:hi])) for lo, hi in zip(at, ends, strict=True)]
        return pa.Table.from_pylist([dict(zip(ASKED.names, r, strict=True)) for r in rows], ASKED_ARROW)

    return placed, placed.groupBy("group").applyInArrow(ask, ASKED), n_texts


def answers(asked: DataFrame) -> DataFrame:
    """For each group and part, the document frequencies of the shingles in the order asked."""

    def answer(table):
        return pa.table([table.column("group"), table.column("part"), pa.array([pack(x) for x in _totals(table)], pa.binary())], names=ANSWER.names)

    return asked.groupBy("part").applyInArrow(answer, ANSWER)


def idf_of(df: np.ndarray, n_texts: int) -> np.ndarray:
    return (1 + np.log(n_texts / df) / np.log(max(n_texts, 2))).astype(np.float32)


def weighted(texts: pa.Array, df: pa.Array, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's place, shingle, weight), sorted by place and shingle; ``df``: each text's packed frequencies."""
    found = [shingles(tokenize(texts.slice(lo, hi - lo)), SHINGLE_WORDS) for lo, hi in slices(texts)]
    starts = [lo for lo, _ in slices(texts)]
    doc = np.concatenate([np.zeros(0, np.int64), *[d + lo for lo, (d, _, _) in zip(starts, found, strict=True)]])
    h, times = (np.concatenate([np.zeros(0, kind), *[x[i] for x in found]]) for i, kind in ((1, U), (2, np.int64)))
    known = [unpack(x.as_py()) for x in df]
    return doc, h, times.astype(np.float32) * idf_of(np.concatenate([np.zeros(0, U), *known]), n_texts)


# --- samples --------------------------------------------------------------


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), at n even steps."""
    at, lo, hi = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < at
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_GAMMA = _gamma_quantiles()
_PER_R = (1 / _GAMMA).astype(np.float32)
#: With 64 added: the logarithms compared below stay positive and order as their bits do.
_LN_C = (np.log(_GAMMA) + 64).astype(np.float32)


def draw(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, samples: int) -> np.ndarray:
    """Improved consistent weighted samples [n_docs, samples]; two texts agree in one with
    the probability of their weighted Jaccard similarity.  Texts without features: 0.

    For feature k: r, c ~ Gamma(2, 1), b ~ U(0, 1), t = floor(ln w / r + b),
    y = exp(r (t - b)), a = c / (y e^r); the sample is (k, t) of the least a.
    """
    out = np.zeros((n_docs, samples), U)
    if not len(h):
        return out
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(starts[1:], len(doc))
    salts = mix(np.arange(1, samples + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    block = 0
    while block < len(starts):
        upto = max(block + 1, int(np.searchsorted(ends, starts[block] + DRAWN, "right")))
        lo, hi = starts[block], ends[upto - 1]
        at, ln_w, key, place = starts[block:upto] - lo, np.log(weight[lo:hi]), h[lo:hi], np.arange(hi - lo)
        bits, high, (b, per_r, t, a) = np.empty(hi - lo, U), np.empty(hi - lo, U), np.empty((4, hi - lo), np.float32)
        index = high.view(np.int64)
        for k in range(samples):
            np.multiply(key, salts[k], out=bits)
            np.right_shift(bits, U(32), out=high)
            bits ^= high
            bits *= U(0xD6E8FEB86659FD93)
            np.right_shift(bits, U(32), out=high)
            bits ^= high
            b[:] = bits.view(np.uint32)[::2]  # the low halves
            b *= np.float32(2.0**-32)
            _PER_R.take(index >> 16, out=per_r, mode="clip")
            index &= 0xFFFF
            _LN_C.take(index, out=a, mode="clip")
            np.multiply(ln_w, per_r, out=t)
            t += b
            np.floor(t, out=t)
            np.subtract(t, b, out=b)
            b += np.float32(1)
            b /= per_r
            a -= b
            order = a.view(np.int32).astype(np.int64)
            order <<= 32
            order |= place
            won = np.minimum.reduceat(order, at) & 0xFFFFFFFF
            out[doc[starts[block:upto]], k] = mix(key[won] * U(0x9E3779B97F4A7C15) ^ t[won].astype(np.int64).astype(U) + U(k))
        block = upto
    return out


def overlap(left: tuple, right: tuple, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of ``n`` pairs of texts by their features."""
    (da, ha, wa), (db, hb, wb) = left, right
    keys = np.concatenate([da.astype(U) << U(52) | ha, db.astype(U) << U(52) | hb])  # n is SLICE_TEXTS at most
    w = np.concatenate([wa, wb]).astype(np.float64)
    order = np.argsort(keys, kind="stable")
    keys, w = keys[order], w[order]
    both = np.flatnonzero(keys[1:] == keys[:-1])
    shared = np.bincount((keys[both] >> U(52)).astype(np.int64), np.minimum(w[both], w[both + 1]), n)
    total = np.bincount(da, wa, n) + np.bincount(db, wb, n) - shared
    return np.divide(shared, total, out=np.zeros(n), where=total > 0)


# --- the job --------------------------------------------------------------

LINK = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("similarity", T.DoubleType())])


def node_of(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.substring(F.sha2(text.cast("string"), 256), 1, 32)


def reach(common: Column, total: Column, threshold: float) -> Column:
    """The greatest total weight of a text that a text of ``total`` can be linked to.

    Both share at most ``common``, the weight of its shingles that other texts have, too.
    """
    least = threshold - 2e-6
    return common * (1 + least) / least - total


def _verified(pairs: DataFrame, texts: DataFrame, n_texts: int, threshold: float) -> DataFrame:
    """``pairs`` (a, b) with their similarity, those of ``threshold`` or more."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.col("df").alias("df_a")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"), F.col("df").alias("df_b")), "b")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                s = overlap(weighted(part.column(2), part.column(3), n_texts), weighted(part.column(4), part.column(5), n_texts), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s)], names=LINK.names).filter(pa.array(s >= threshold - 1e-6))

    return both.select("a", "b", "text_a", "df_a", "text_b", "df_b").mapInArrow(run, LINK)


def _pairs(x: DataFrame, left: str, right: str) -> DataFrame:
    return x.filter(F.col(left) != F.col(right)).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct()


def _blocks(open_: DataFrame, threshold: float) -> DataFrame:
    """Where each open member is compared: ``open_`` (bucket, node, label, total, reach) with minor, the
    block's group, left, right, i and j, and side (0: compared with those of side 1).

    A bucket of one block shares its group with others.  In a larger one a text is compared
    with those whose total weight, by steps of the threshold, is the same or next, if any
    of these is within its reach and reaches it.
    """
    counts = open_.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    sizes = cut(counts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").alias("size")))
    groups = max(1, open_.count() // BLOCK)
    minor = (F.col("label") != F.col("major")).alias("minor")
    sized = open_.join(sizes, "bucket")
    sized = sized.select("bucket", "node", "label", "total", "reach", "size", minor, F.floor(F.log("total") / F.lit(-1.0001 * float(np.log(threshold)))).alias("cell"))
    sized = cut(sized)  # so that Spark can split a hot bucket in the join and counts it in parts
    small = sized.filter(F.col("size") <= BLOCK).select("bucket", "node", "label", "reach", "minor", F.pmod(F.xxhash64("bucket"), F.lit(groups)).alias("group"), *[F.lit(0).cast("long").alias(c) for c in ("left", "right", "i", "j")])
    sides = [small.filter("minor").withColumn("side", F.lit(0)), small.withColumn("side", F.lit(1))]
    large = sized.filter(F.col("size") > BLOCK)
    least = [F.min(F.when(F.col("minor"), F.col("total"))).alias("minors_least"), F.min("total").alias("all_least")]
    most = [F.max(F.when(F.col("minor"), F.col("reach"))).alias("minors_most"), F.max("reach").alias("all_most")]
    cells = cut(large.groupBy("bucket", "cell").agg(F.count_if("minor").alias("minors"), F.count("*").alias("all"), *least, *most))
    for side, mine, other, rows in ((0, "minors", "all", large.filter("minor")), (1, "all", "minors", large)):
        own = cells.select("bucket", "cell", F.col(mine).alias("here"))
        there = cells.filter(F.col(other) > 0).select("bucket", F.col("cell").alias("facing"), F.col(other).alias("there"), F.col(f"{other}_least").alias("least"), F.col(f"{other}_most").alias("most"))
        met = rows.join(own, ["bucket", "cell"]).withColumn("facing", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))).join(there, ["bucket", "facing"])
        met = met.filter((F.col("least") <= F.col("reach")) & (F.col("total") <= F.col("most")))
        my = F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("here") / BLOCK)).cast("long")
        their = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("there") / BLOCK).cast("long") - 1))
        at = (("cell", "left"), ("facing", "right"), (my, "i"), (their, "j")) if side == 0 else (("facing", "left"), ("cell", "right"), (their, "i"), (my, "j"))
        places = [(F.col(c) if isinstance(c, str) else c).alias(name) for c, name in at]
        sides.append(met.select("bucket", "node", "label", "reach", "minor", F.col("bucket").alias("group"), *places).withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])


def _compare_blocks(open_: DataFrame, texts: DataFrame, n_texts: int, threshold: float) -> DataFrame:
    """Links between members of one bucket in different classes, of each node the best one to
    each other class; ``open_``: bucket, node, label, total, reach; ``texts``: node, text, df, keys."""

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("bucket", kind="stable")
        left, right = block[block["side"] == 0], block[block["side"] == 1]
        found = []
        if len(left) and len(right):
            (dl, hl, wl), (dr, hr, wr) = (weighted(pa.array(x["text"], pa.string()), pa.array(x["df"], pa.binary()), n_texts) for x in (left, right))
            from_l, from_r = np.searchsorted(dl, np.arange(len(left) + 1)), np.searchsorted(dr, np.arange(len(right) + 1))
            total = np.bincount(dr, wr, len(right))
            keys_l, keys_r = np.stack(left["keys"]), np.stack(right["keys"])
            reaches = left["reach"].to_numpy()
            names, labels, minor = right["node"].to_numpy(), right["label"].to_numpy(), right["minor"].to_numpy()
            buckets, far = left["bucket"].to_numpy(), right["reach"].to_numpy()
            bands = (keys_l == buckets[:, None]).argmax(1)
            lows, highs = (np.searchsorted(right["bucket"].to_numpy(), buckets, side) for side in ("left", "right"))
            for i, (node, label, band, lo, hi) in enumerate(zip(left["node"], left["label"], bands, lows, highs, strict=True)):
                h, w = hl[from_l[i] : from_l[i + 1]], wl[from_l[i] : from_l[i + 1]]
                mine = w.sum(dtype=np.float64)
                could = (total[lo:hi] <= reaches[i]) & (mine <= far[lo:hi])
                first = (keys_r[lo:hi] == keys_l[i]).argmax(1) == band
                here = lo + np.flatnonzero(could & first & (labels[lo:hi] != label) & (~minor[lo:hi] | (names[lo:hi] > node)))
                if not len(here):
                    continue
                n = from_r[here + 1] - from_r[here]
                spot = np.repeat(from_r[here] - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = np.minimum(np.searchsorted(h, hr[spot]), len(h) - 1)
                least = np.where(h[at] == hr[spot], np.minimum(w[at], wr[spot]), 0)
                shared = np.add.reduceat(least.astype(np.float64), np.cumsum(n) - n)
                s = shared / (total[here] + mine - shared)
                best = {labels[here[k]]: k for k in np.argsort(s, kind="stable") if s[k] >= threshold - 1e-6}  # one link joins two classes
                found += [(min(node, names[here[k]]), max(node, names[here[k]]), float(s[k])) for k in best.values()]
        return pd.DataFrame(found, columns=LINK.names)

    return _blocks(open_, threshold).join(texts, "node").groupBy("group", "left", "right", "i", "j").applyInPandas(compare, LINK)  # a few times BLOCK texts a group


def signatures(texts: DataFrame, bands: int, rows: int) -> tuple[DataFrame, int]:
    """((node, keys, df, total, common) of ``texts`` (node, text), texts).

    keys: the bucket in each band, null for a text without words; df: packed document
    frequencies of its shingles; total: its weight; common: of its shingles that other texts have, too.
    """
    placed, asked, n_texts = dealt(texts)
    schema = T.StructType([T.StructField("node", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("df", T.BinaryType()), T.StructField("total", T.DoubleType()), T.StructField("common", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def sign(table, answered):
        shingled = _shingled(table.column("text").combine_chunks())
        found, _ = _distinct(shingled)
        order = np.argsort(answered.column("part").to_numpy(), kind="stable")
        frequency = np.concatenate([np.zeros(0, U), *[unpack(answered.column("df")[int(i)].as_py()) for i in order]])
        if len(found) != len(frequency):
            raise ValueError("a group of texts has other shingles than it asked for")
        keys, dfs, totals, common = [], [], [], []
        for n, doc, h, times in shingled:
            df = frequency[np.searchsorted(found, h)]
            weight = times.astype(np.float32) * idf_of(df, n_texts)
            drawn = draw(doc, h, weight, n, bands * rows)
            key = np.zeros((n, bands), U)
            for i in range(rows):
                key = mix(key * U(0x9E3779B97F4A7C15) + drawn[:, i::rows])
            key += np.arange(bands, dtype=U)
            some = np.bincount(doc, minlength=n)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(key.astype(np.int64).ravel()))
            keys.append(pa.compute.if_else(pa.array(some > 0), flat, None))
            dfs += [pack(x) for x in np.split(df, np.cumsum(some)[:-1])]
            totals.append(np.bincount(doc, weight, n))
            common.append(np.bincount(doc, np.where(df > 1, weight, 0), n))
        columns = [table.column("node"), pa.chunked_array(keys, arrow.field("keys").type), pa.array(dfs, pa.binary()), *[pa.array(np.concatenate([np.zeros(0), *x])) for x in (totals, common)]]
        return pa.table([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], arrow)

    return placed.groupBy("group").cogroup(answers(asked).groupBy("group")).applyInArrow(sign, schema), n_texts


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(nodes, joining links) of ``docs`` (doc_id, text).

    nodes: node (of equal texts), n_copies, doc_id (the smallest of its
    copies), class_id (the smallest doc_id of its class), class_node (the
    smallest node of its class, which no other class has), chosen (the node
    that stands for its class: one a class).
    links: a, b, similarity of different texts that were compared and pass; they
    join each class, but aren't all of its pairs.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    bounded_batches(docs.sparkSession)
    distinct = cut(docs.groupBy(node_of(F.col("text")).alias("node")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("text").alias("text")))
    free_shuffles(docs.sparkSession)
    signed, n_texts = signatures(distinct, bands, rows)
    signed = cut(signed)
    free_shuffles(docs.sparkSession)
    far = reach(F.col("common"), F.col("total"), threshold).alias("reach")
    members = signed.select("node", "total", far, F.explode("keys").alias("bucket"))
    order = [F.struct(F.xxhash64("node", F.lit(i)), "node") for i in range(2)]
    leaders = cut(members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("total").alias("least"), *[F.min(o).getField("node").alias(f"leader{i}") for i, o in enumerate(order)]).filter("size > 1"))
    shared = cut(members.join(leaders, "bucket").filter(F.col("reach") >= F.col("least")).drop("total", "reach", "least"))
    weights = cut(signed.select("node", "total", far))
    drop(leaders)
    free_shuffles(docs.sparkSession)

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose total weights allow the threshold: the others can't be links."""
        a, b = (weights.select(F.col("node").alias(x), F.col("total").alias(f"total_{x}"), F.col("reach").alias(f"reach_{x}")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b")
        return both.filter((F.col("total_a") <= F.col("reach_b")) & (F.col("total_b") <= F.col("reach_a"))).select("a", "b")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text, df, keys), cut, of ``nodes`` alone."""
        held = signed.select("node", "df", "keys").join(nodes.distinct(), "node").join(distinct.select("node", "text"), "node")
        held = cut(held.select("node", "text", "df", "keys"))
        free_shuffles(docs.sparkSession)
        return held

    def verified(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        found = cut(_verified(pairs, texts, n_texts, threshold))
        drop(texts)
        free_shuffles(docs.sparkSession)
        return found

    pairs = cut(possible(_pairs(shared.select("node", F.explode(F.array("leader0", "leader1")).alias("leader")), "node", "leader")))
    links = verified(pairs)
    classes = connected(links)
    left = None
    while True:
        labelled = cut(shared.select("bucket", "node").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node")))
        mixed = cut(labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("bucket"))
        open_ = cut(labelled.join(mixed, "bucket").join(weights, "node"))
        drop(labelled, mixed)
        free_shuffles(docs.sparkSession)
        before, left = left, open_.count()
        if not left:
            break
        last = before is not None and left > before / 2
        if last:
            texts = texts_of(open_.select("node"))
            more = cut(_compare_blocks(open_, texts, n_texts, threshold))
            drop(texts)
        else:
            degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
            best = open_.join(degree, "node", "left").groupBy("bucket").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), "node", "label")).alias("best"))
            lead = cut(best.select("bucket", F.col("best.node").alias("other"), F.col("best.label").alias("other_label")))
            found = _pairs(open_.join(lead, "bucket").filter(F.col("label") != F.col("other_label")), "node", "other")
            fresh = cut(possible(found).join(pairs, ["a", "b"], "left_anti"))
            more, pairs = verified(fresh), pairs.unionByName(fresh)
        if not more.isEmpty():
            links = links.unionByName(more)
            classes = connected(links)
        elif not last:
            left = 0  # leaders find nothing more: compare in blocks
        if last:
            break
    ids = cut(distinct.select("node", "doc_id", "n_copies"))
    drop(signed, weights, distinct)
    labelled = ids.join(classes, "node", "left").select("node", "doc_id", "n_copies", F.coalesce("label", "node").alias("label"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).getField("node")
    least = cut(labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"), first.alias("first")))
    out = labelled.join(least, "label")
    return out.select("node", "n_copies", "doc_id", "class_id", F.col("label").alias("class_node"), (F.col("node") == F.col("first")).alias("chosen")), links


def classify(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, class_node, n_copies, kept.

    class_node tells classes apart whose doc_ids are repeated or null.
    kept: the row that ``one_of_each`` leaves (and rows equal to it in doc_id
    and text).  Rows with a null text are kept.
    """
    nodes, _ = near_duplicates(docs)
    rows = docs.select("doc_id", node_of(F.col("text")).alias("node"))
    out = rows.join(nodes.withColumnRenamed("doc_id", "node_doc"), "node", "left")
    mine = F.col("node").isNull() | (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("node_doc")))
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    return out.select("doc_id", class_id, "class_node", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), mine.alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest doc_id.

    Of rows that are equal in doc_id and text any one stays.
    """
    nodes, _ = near_duplicates(docs)
    key = F.xxhash64("node", "doc_id").alias("key")  # a hot text is dealt out by its copies' ids
    keep = nodes.filter("chosen").select("node", F.col("doc_id").alias("node_doc"), key)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), node_of(F.col("text")).alias("node"), "doc_id")
    one = packed.select("doc", "node", key).join(keep, ["node", "key"]).filter(F.col("doc.doc_id").eqNullSafe(F.col("node_doc"))).dropDuplicates(["node", "key"])
    return one.select("doc.*").unionByName(docs.filter(F.col("text").isNull()))
