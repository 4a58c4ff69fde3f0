"""Format detection over a landing zone: every file scored for every format, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators.lines import is_blank
from loomlog.operators.rules import ALL_RULES, BlockRule, LineRule, XmlRule

SNIFF_BYTES, LINE_BYTES, SAMPLE_LINES, FIRST_LINE_BYTES = 512, 16 << 10, 200, 300
#: A first line that is an object is looked for in as much of a file.
HEAD_BYTES = 1 << 20

# File signatures and extensions.
PARQUET_MAGIC, EVENT_MAGIC = b"PAR1", b"ElfFile\x00"
BOMS = (("UTF-8 BOM", "EFBBBF"), ("UTF-16 LE BOM", "FFFE"), ("UTF-16 BE BOM", "FEFF"))


def _text(head: Column, n: int) -> Column:
    """The first ``n`` bytes as text, without a byte order mark, line ends folded."""
    raw = F.substring(head, 1, n)
    body = F.when(F.hex(F.substring(head, 1, 3)) == "EFBBBF", F.substring(raw, F.lit(4), F.lit(n))).otherwise(raw)
    return F.replace(F.decode(body, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n"))


def with_samples(heads: DataFrame) -> DataFrame:
    """``heads`` (path, head) with extension, text samples and the first lines."""
    out = heads.withColumn("ext", F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1)))
    out = out.withColumn("sniffed", _text(F.col("head"), SNIFF_BYTES))
    lines = F.filter(F.split(_text(F.col("head"), LINE_BYTES), "\n"), lambda line: ~is_blank(line))
    out = out.withColumn("sample", F.slice(lines, 1, SAMPLE_LINES))
    whole = F.substring_index(F.regexp_replace(_text(F.col("head"), HEAD_BYTES), r"^\s+", ""), "\n", 1)
    return out.withColumn("first_line", F.get("sample", F.lit(0))).withColumn("whole_line", whole)


def _object(line: Column) -> Column:
    return F.coalesce(F.ltrim(line).startswith("{") & F.try_parse_json(line).isNotNull(), F.lit(False))


def _scores(rules) -> list[Column]:
    """One struct (adapter, score, reason) a format; the score is 0 where it doesn't fit."""
    ext, sniffed, sample, first, head = (F.col(c) for c in ("ext", "sniffed", "sample", "first_line", "head"))

    def entry(adapter: Column, score: Column, reason: Column) -> Column:
        return F.struct(adapter.alias("adapter"), score.cast("int").alias("score"), reason.alias("reason"))

    brace = F.coalesce(F.ltrim(sniffed).startswith("{"), F.lit(False))
    whole = _object(F.col("whole_line"))
    ndjson = F.when(ext == ".ndjson", 90).when(~brace, 0).when(whole & (ext == ".json"), 70).when(whole, 90).otherwise(0)
    why = F.when(ext == ".ndjson", F.lit("extension .ndjson")).when(F.coalesce(first, F.lit("")) == "", F.lit("file is empty")).when(~brace, F.lit("first character is not an opening brace")).when(whole, F.lit("first line is a JSON object")).otherwise(F.lit("first line is not a whole JSON object"))
    out = [entry(F.lit("ndjson"), ndjson, why)]
    magic = F.substring(head, 1, 4) == F.lit(PARQUET_MAGIC)
    named = ext.isin(".parquet", ".pq")
    out.append(entry(F.lit("parquet"), F.when(magic, 100).when(named, 90).otherwise(0), F.when(magic, F.lit("starts with the Parquet signature")).when(named, F.lit("Parquet extension")).otherwise(F.lit("no Parquet signature or extension"))))
    event = F.substring(head, 1, 8) == F.lit(EVENT_MAGIC)
    out.append(entry(F.lit("evtx"), F.when(event, 100).otherwise(0), F.when(event, F.lit("starts with the event log signature")).otherwise(F.lit("no event log signature"))))
    for family, kind in (("block", BlockRule), ("xml", XmlRule)):
        mine = sorted((r for r in rules if isinstance(r, kind)), key=lambda r: -r.priority)
        if mine:
            fits = [sniffed.rlike(f"(?m){r.sniff or r.separator}" if family == "block" else r.sniff) for r in mine]
            out.append(_best(family, mine, fits, "sniff pattern"))
    lines = sorted((r for r in rules if isinstance(r, LineRule)), key=lambda r: -r.priority)
    if lines:
        out.append(_best("line", lines, [F.exists(sample, _matcher(r)) for r in lines], "line pattern"))
    return out


def _matcher(rule: LineRule):
    return lambda line: line.rlike(rule.pattern)


def _best(family: str, rules, fits: list[Column], what: str) -> Column:
    score, reason = F.lit(0), F.lit(f"no {what} matches")
    for rule, fit in reversed(list(zip(rules, fits, strict=True))):
        score = F.when(fit, F.lit(rule.priority)).otherwise(score)
        reason = F.when(fit, F.lit(f"{what} of {rule.name} matches")).otherwise(reason)
    return F.struct(F.lit(family).alias("adapter"), score.cast("int").alias("score"), reason.alias("reason"))


def notes(head: Column, sample: Column) -> Column:
    """What is odd about a file's encoding, as an array of words."""
    first = F.hex(F.substring(head, 1, 3))
    text = F.decode(head, "ISO-8859-1")
    checks = [F.when(F.length(head) == 0, F.lit("empty file"))]
    checks += [F.when(first.startswith(code), F.lit(name)) for name, code in BOMS]
    checks += [
        F.when(F.contains(text, F.lit("\r\n")), F.lit("CRLF line ends")),
        F.when(F.contains(text, F.lit("\x00")), F.lit("NUL bytes")),
        F.when(~F.is_valid_utf8(head.cast("string")), F.lit("invalid UTF-8")),
        F.when(F.size(sample) == 0, F.lit("no non-blank line")),
    ]
    return F.array_compact(F.array(*checks))


def diagnose(heads: DataFrame, rules=ALL_RULES) -> DataFrame:
    """(path, adapter, score, reason, rank, chosen): every format of every file, best first, ties by name."""
    scored = with_samples(heads).select("path", F.inline(F.array(*_scores(rules))))
    order = Window.partitionBy("path").orderBy(F.desc("score"), F.asc("adapter"))  # one row a format
    return scored.withColumn("rank", F.row_number().over(order)).withColumn("chosen", (F.col("rank") == 1) & (F.col("score") > 0))


def classify_files(heads: DataFrame, rules=ALL_RULES) -> DataFrame:
    """(path, adapter, score, notes, first_line): the winning format, null where none fits; no shuffle."""
    out = with_samples(heads)
    best = F.array_max(F.transform(F.array(*_scores(rules)), lambda s: F.struct(s["score"].alias("score"), _reversed(s["adapter"]).alias("order"), s["adapter"].alias("adapter"))))
    out = out.withColumn("__best", best)
    fits = F.col("__best.score") > 0
    line = F.make_valid_utf8(F.substring(F.encode("first_line", "ISO-8859-1"), 1, FIRST_LINE_BYTES).cast("string"))  # a character may be cut
    return out.select("path", F.when(fits, F.col("__best.adapter")).alias("adapter"), F.col("__best.score").alias("score"), notes(F.col("head"), F.col("sample")).alias("notes"), line.alias("first_line"))


def _reversed(name: Column) -> Column:
    """A number that is larger the earlier a short name comes in the alphabet."""
    return -F.conv(F.rpad(F.hex(F.substring(name, 1, 6)), 12, "0"), 16, 10).cast("long")
