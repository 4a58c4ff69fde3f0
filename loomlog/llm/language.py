"""Language by mixture inference: which languages, in what proportions, made a text's words?

Each language has a smoothed model of hashed character n-grams, counted over
all labelled documents given.  A word's likelihood under a language is the
tempered product over its n-grams.  Expectation-maximisation estimates each
document's proportions; then languages are dropped, least first, as long as
the penalised likelihood (BIC with ``penalty``) doesn't fall.  Estimation takes
``ITERATIONS`` rounds, and ``AGAIN`` from there after each language dropped; it
isn't run until nothing moves.  The prediction is the language with the largest
proportion, which is the score.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without labelled rows everything is ``und``; repeated rows get equal results;
tied proportions go to the language first in order; labels of more than
``MAX_LANGUAGES`` languages are an error, since the model is sent to executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.batches import gather_texts, map_texts
from loomlog.llm.words import LETTERS, U, pieces, tokenize

BUCKETS = 1 << 15
SIZES = (1, 2, 3, 4)
#: N-grams overlap, so their product says too much: its logarithm is scaled.
TEMPER = 0.35
ITERATIONS, AGAIN = 8, 3
#: Weight of ln(words) for each language in a document's set.
PENALTY = 2.0
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Most languages a model may have: its size is this times BUCKETS at most.
MAX_LANGUAGES = 500


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # [languages, BUCKETS]


def distinct_words(texts: pa.Array):
    """(tokens, places of one token of each distinct word, each token's distinct word)."""
    tokens = tokenize(texts, LETTERS)
    _, which, inverse = np.unique(tokens.hashes(), return_index=True, return_inverse=True)
    return tokens, which, inverse


def ngrams(tokens, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner, h = pieces(tokens, which, SIZES)
    return owner, (h >> U(20)).astype(np.int64) % BUCKETS


def fit(labelled: DataFrame, alpha: float = 0.5) -> Model:
    """From all rows of ``labelled`` (lang, text); rows with a null lang are left out."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def make():
        counts: dict[str, np.ndarray] = {}

        def add(batch):
            names = batch.column(0).dictionary_encode()
            tokens, which, inverse = distinct_words(batch.column(1))
            owner, bucket = ngrams(tokens, which)
            lang = names.indices.to_numpy(zero_copy_only=False)[tokens.doc]
            for i, name in enumerate(names.dictionary.to_pylist()):
                times = np.bincount(inverse[lang == i], minlength=len(which))
                total = np.bincount(bucket, times[owner], BUCKETS)
                counts[name] = counts[name] + total if name in counts else total
            return iter(())

        def finish():
            for name, total in counts.items():
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some].astype(np.int64))], names=schema.names)

        return add, finish

    rows = labelled.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = gather_texts(rows, schema, make).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = found.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))  # BUCKETS entries a language at most
    rows = sorted(by_lang.limit(MAX_LANGUAGES + 1).collect())
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    logp = np.zeros((len(rows), BUCKETS))
    for i, (_, bucket, n) in enumerate(rows):
        counts = np.full(BUCKETS, alpha)
        counts[bucket] += n
        logp[i] = np.log(counts / counts.sum())
    return Model([r[0] for r in rows], logp.astype(np.float32))


def infer(model: Model, texts: pa.Array, penalty: float = PENALTY) -> np.ndarray:
    """Proportions [texts, languages]; a language outside a text's set has 0, a wordless text all 0."""
    tokens, which, inverse = distinct_words(texts)
    n, n_lang = len(texts), len(model.languages)
    out = np.zeros((n, n_lang), np.float32)
    if not len(which) or not n_lang:
        return out
    owner, bucket = ngrams(tokens, which)
    ll = np.stack([np.bincount(owner, p[bucket], len(which)) for p in model.logp], 1) * TEMPER
    top = ll.max(1, keepdims=True)
    likely = np.exp(ll - top).astype(np.float32)[inverse]
    doc = tokens.doc
    real, first, counts = np.unique(doc, return_index=True, return_counts=True)
    place = np.repeat(np.arange(len(real)), counts)

    def fitted(likely, first, counts, place, pi, times):
        for _ in range(times):
            joint = likely * pi[place]
            total = joint.sum(1)
            joint /= np.maximum(total, 1e-30)[:, None]
            pi = np.add.reduceat(joint, first) / counts[:, None]
        return pi, np.add.reduceat(np.log(np.maximum((likely * pi[place]).sum(1), 1e-30)), first)

    pi, fit_ll = fitted(likely, first, counts, place, np.full((len(real), n_lang), 1 / n_lang, np.float32), ITERATIONS)
    best = pi.copy()
    cost = penalty * np.log(counts + 1)
    going = np.arange(len(real))
    for left in range(n_lang - 1, 0, -1):
        used = np.where(best[going] > 0, best[going], np.inf)
        drop = used.argmin(1)
        trial = best[going].copy()
        trial[np.arange(len(going)), drop] = 0
        trial /= np.maximum(trial.sum(1, keepdims=True), 1e-30)
        chosen = np.zeros(len(real), bool)
        chosen[going] = True
        mine = chosen[place]
        c = counts[going]
        trial, ll_now = fitted(likely[mine], np.cumsum(c) - c, c, np.repeat(np.arange(len(going)), c), trial, AGAIN)
        better = ll_now + cost[going] >= fit_ll[going]
        best[going[better]], fit_ll[going[better]] = trial[better], ll_now[better]
        going = going[better]
        if not len(going):
            break
    out[real] = best
    return out


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` (columns ``keep``; default all) with lang_pred, score and langs, the set (name, share) by share."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LANGUAGES x BUCKETS floats at most
    share = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.FloatType())])
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.ArrayType(share))]

    def make():
        names = sent.value.languages

        def fn(texts: pa.Array) -> list[pa.Array]:
            pi = infer(sent.value, texts)
            letters = np.array([bool(LETTER.search(t)) for t in texts.to_pylist()], bool)
            known = letters & (pi.sum(1) > 0) if len(names) else np.zeros(len(texts), bool)
            top = pi.argmax(1) if len(names) else np.zeros(len(texts), int)
            pred = [names[i] if k else UNKNOWN for i, k in zip(top, known, strict=True)]
            score = np.where(known, np.clip(pi[np.arange(len(pi)), top], 0, 1), 0.0) if len(names) else np.zeros(len(texts))
            sets = [sorted(({"lang": names[j], "share": float(row[j])} for j in np.flatnonzero(row)), key=lambda x: -x["share"]) if k else [] for row, k in zip(pi, known, strict=True)]
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float32())])))]

        return fn

    return map_texts(docs, fields, make, text, keep)
