"""Quality rules: a table of thresholds compiled into one Spark projection.

Words are runs of characters other than space and the five ASCII controls
beside it.  All measures are built-in functions over the text; there is no user
function and no shuffle.

Defined results: null and empty texts have no words, lines or symbols, ratios
over nothing are 0, and both fail the base rules; every row is judged alone, so
repeated rows get repeated verdicts; other columns play no part.
Windows of three words are compared by a 64-bit hash of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.batches import let

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the a and of to in is it that for on with as was at by be this from or an are "
    "le la les de des un une et en du que qui dans pour sur par avec pas est au "
    "der die das und ein eine den von zu mit ist des im für auf nicht sich auch "
    "el los las del y que se con por una su para es al lo como no"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` must hold; None: no bound on that side."""

    measure: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        c = F.col(self.measure)
        terms = [c >= self.low] * (self.low is not None) + [c <= self.high] * (self.high is not None)
        return terms[0] if len(terms) == 1 else terms[0] & terms[1]


BASE_RULES = (Rule("n_words", low=50), Rule("repeat_word_ratio", high=0.5))
RULES = (
    Rule("mean_word_chars", 2, 15),
    Rule("symbol_ratio", high=0.1),
    Rule("digit_ratio", high=0.25),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.3),
    Rule("ellipsis_line_ratio", high=0.3),
    Rule("longest_word", high=1000),
)

_SPACE = "[\\x20\\x09-\\x0D]"


def _removed(text: Column, pattern: str) -> Column:
    """How many characters a pattern takes from a text."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _repeated(words: Column) -> Column:
    """How many words stand in a window of three that is found twice or more; null under three words."""

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    window = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) >= 3, let(F.array_sort(window), lambda s: let(starts(s), covered)))


def measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns (under ``__keep``) and all measures of each row."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__keep"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    t = F.col("__t")
    out = out.withColumn("__w", F.filter(F.split(t, _SPACE + "+"), lambda w: w != ""))
    out = out.withColumn("__l", F.filter(F.split(t, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")))
    w, n = F.col("__w"), F.size("__w")
    out = out.select(
        "__keep",
        n.cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.array_max(F.transform(w, lambda x: F.length(x))).alias("longest_word"),
        _removed(t, "[#*$%&|<>]+").alias("n_symbols"),
        _removed(t, "[0-9]+").alias("n_digits"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_ellipsis_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stop_words"),
        F.coalesce(let(w, _repeated), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return out.select(
        "*",
        F.coalesce("longest_word", F.lit(0)).alias("__longest"),
        _ratio("word_chars", "n_words").alias("mean_word_chars"),
        _ratio("n_symbols", "n_words").alias("symbol_ratio"),
        _ratio("n_digits", "word_chars").alias("digit_ratio"),
        _ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _ratio("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
        _ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    ).withColumn("longest_word", F.col("__longest")).drop("__longest")


def judge(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``keep`` columns (under ``__keep``), measures, base_failed, failed (names of broken rules), kept."""
    out = measures(docs, keep, text)
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | ~rule.passes()
    broken = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.measure)) for r in rules]))
    return out.withColumn("base_failed", base).withColumn("failed", broken).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
