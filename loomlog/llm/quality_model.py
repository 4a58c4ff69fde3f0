"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words, punctuation runs and pairs of neighbours (a token that repeats the one
before makes one common pair) are hashed into ``BUCKETS``.  The raw model
counts all documents; the target model counts a bounded sample of documents
labelled good (at most ``max_target``, by hash of doc_id).  A document's log
weight is the sum over its n-grams of ln p_target - ln p_raw; of a document
with more than ``LENGTH`` n-grams it is what LENGTH of them have on average, so
that long texts don't drown the others.  A document of the target sample is
left out of the target model that weighs it, so it gains nothing from having
been shown.

Adding Gumbel noise and taking the k largest keys samples k documents without
replacement in proportion to their weights.  k defaults to the number of
documents that weigh at least as much as all but 1 - ``SHARE`` of the target
sample, each weighed without itself.

Defined results: null and empty texts have log weight 0; repeated rows have
equal keys and are all kept or all rejected; keys that tie with the k-th are
kept; without labelled documents every log weight is 0 and every document is
kept; a null doc_id has no label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.batches import cut, fresh, gather_texts, map_texts
from loomlog.llm.words import U, WORD_PUNCT, mix, tokenize

BUCKETS = 1 << 15
#: Documents labelled good that the target model counts, at most.
MAX_TARGET = 20_000
#: N-grams' worth of the raw model that smooths the target model.
PRIOR = 4 * BUCKETS
#: N-grams that a long document counts for.
LENGTH = 200
#: Of the target sample, the share that weighs enough.
SHARE = 0.998
SEED = 17
REPEAT = U(0x632BE59BD9B4E019)


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, bucket) of each n-gram."""
    tokens = tokenize(texts, WORD_PUNCT)
    h, doc = tokens.hashes(), tokens.doc
    same = doc[1:] == doc[:-1]
    pairs = np.where(h[1:] == h[:-1], REPEAT, mix(h[:-1] * U(3) + h[1:]))[same]
    grams = np.concatenate([h, pairs])
    return np.concatenate([doc, doc[1:][same]]), (grams >> U(20)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    """n-gram counts by bucket of all documents (``raw``) and of the target sample."""

    raw: np.ndarray
    target: np.ndarray

    @property
    def p_raw(self) -> np.ndarray:
        return (self.raw + 1) / (self.raw + 1).sum()

    def weigh(self, texts: pa.Array, shown: np.ndarray) -> np.ndarray:
        """The log weight of each text; those ``shown`` to the target model are left out of it."""
        n, total = len(texts), self.target.sum()
        if not total:
            return np.zeros(n)
        doc, bucket = ngrams(texts)
        p, size = self.p_raw, np.bincount(doc, minlength=n)
        ratios = np.log((self.target + PRIOR * p) / (total + PRIOR) / p)
        value = ratios[bucket]
        mine = np.flatnonzero(shown[doc])
        _, which, times = np.unique(doc[mine] * BUCKETS + bucket[mine], return_inverse=True, return_counts=True)
        others = np.maximum(self.target[bucket[mine]] - times[which], 0)
        value[mine] = np.log((others + PRIOR * p[bucket[mine]]) / (np.maximum(total - size[doc[mine]], 0) + PRIOR) / p[bucket[mine]])
        return np.bincount(doc, value, n) * np.minimum(1, LENGTH / np.maximum(size, 1))


def target_sample(good: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """At most ``max_target`` doc_ids labelled good, by hash."""
    return good.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)


def marked(docs: DataFrame, sample: DataFrame, name: str) -> DataFrame:
    """``docs`` with the column ``name``: is the doc_id in the sample?  (A broadcast of ``max_target`` ids.)"""
    return docs.join(F.broadcast(sample.withColumn(name, F.lit(True))), "doc_id", "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(name), F.lit(False)).alias(name))


def fit(docs: DataFrame, good: DataFrame, max_target: int = MAX_TARGET) -> Model:
    """From all texts of ``docs`` (doc_id, text); ``good``: the doc_ids labelled good."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "raw", "target")])

    def make():
        counts = np.zeros((2, BUCKETS), np.int64)

        def add(batch):
            doc, bucket = ngrams(batch.column(1))
            target = batch.column(0).to_numpy(zero_copy_only=False)
            counts[0] += np.bincount(bucket, minlength=BUCKETS)
            counts[1] += np.bincount(bucket[target[doc]], minlength=BUCKETS)
            return iter(())

        def finish():
            some = np.flatnonzero(counts[0])
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=schema.names)

        return add, finish

    shown = marked(docs.select("doc_id", "text"), target_sample(good, max_target), "__target").select("__target", "text")
    found = gather_texts(shown, schema, make).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    model = Model(np.zeros(BUCKETS), np.zeros(BUCKETS))
    for b, n, m in found:
        model.raw[b], model.target[b] = n, m
    return model


def log_weights(docs: DataFrame, model: Model, sample: DataFrame, keep: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` (columns ``keep``; default all) with log_weight, key (its sum with noise that
    doc_id, text and seed decide) and target (in the sample)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two numbers a bucket
    bits = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 52)).cast("double")

    def make():
        def fn(texts: pa.Array, shown: pa.Array) -> list[pa.Array]:
            return [pa.array(sent.value.weigh(texts, shown.to_numpy(zero_copy_only=False)))]

        return fn

    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("log_weight", "key", "target")]
    noise, shown = fresh(docs.columns, "__gumbel"), fresh(docs.columns, "__target")
    noisy = marked(docs, sample, shown).withColumn(noise, -F.log(-F.log((bits + 0.5) / (1 << 52))))
    out = map_texts(noisy, [T.StructField("log_weight", T.DoubleType())], make, keep=[*keep, noise, shown], beside=shown)
    return out.select(*[F.col(f"`{c}`") for c in keep], "log_weight", (F.col("log_weight") + F.col(noise)).alias("key"), F.col(shown).alias("target"))


def kth_largest(values: DataFrame, name: str, k: int, bins: int = 1000, few: int = 10_000) -> float:
    """The k-th largest value of a column (k >= 1), by counts in ever narrower ranges."""
    lo, hi = values.agg(F.min(name), F.max(name)).first()
    above = 0
    while True:
        inside = values.filter(F.col(name).between(lo, hi))
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo or inside.limit(few + 1).count() <= few:
            break
        spot = F.least(F.floor((F.col(name) - lo) / width), F.lit(bins - 1))
        counts = dict(inside.groupBy(spot.alias("bin")).count().collect())  # ``bins`` rows at most
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= k:
                break
            above += counts[b]
        edge = inside.filter(spot == b).agg(F.min(name), F.max(name)).first()
        if tuple(edge) == (lo, hi):
            break
        lo, hi = edge
    if lo == hi:
        return lo
    top = inside.orderBy(F.desc(name)).limit(min(k - above, few)).agg(F.min(name))
    return top.first()[0]


def least_key(scored: DataFrame, k: int | None = None) -> float:
    """The least key that is kept of ``scored`` (log_weight, key, target); k: see above."""
    if k is None:
        shown = scored.filter("target")
        n = shown.count()
        enough = kth_largest(shown, "log_weight", math.ceil(SHARE * n)) if n else -math.inf
        k = scored.filter(F.col("log_weight") >= enough).count()
    return kth_largest(scored, "key", k) if k > 0 else math.inf


def resample(docs: DataFrame, good: DataFrame, k: int | None = None, max_target: int = MAX_TARGET) -> DataFrame:
    """doc_id of each document, with log_weight, key, target and kept."""
    sample = cut(target_sample(good, max_target))
    scored = cut(log_weights(docs, fit(docs, good, max_target), sample, ["doc_id"]))
    return scored.withColumn("kept", F.col("key") >= least_key(scored, k))


def keep_good(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The documents that importance resampling keeps, all their columns.

    They are weighed once to find the least key that is kept, and once more while
    they are written, so no copy of them lies in the shared folder.
    """
    model, sample = fit(docs, good), cut(target_sample(good))
    least = least_key(cut(log_weights(docs, model, sample, [])))
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    return log_weights(packed, model, sample, ["__doc"]).filter(F.col("key") >= least).select("__doc.*")
