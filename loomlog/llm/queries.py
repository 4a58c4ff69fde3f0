"""The registered queries of the ten operators: whole tables in, contract columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import alignment, bpe, decontaminate, language, licenses, near_dup, periodic, pii, quality_model, quality_rules, sharding, toxicity, urls
from loomlog.llm.batches import let

N_SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classify(table(spark, sf_dir, "documents"))


def good_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.resample(table(spark, sf_dir, "documents"), good_ids(spark, sf_dir)).drop("target")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0)
    network = toxicity.fit(docs, labels)
    scored = toxicity.score_texts(docs, network, ["doc_id"])
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("__keep.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(remainder(4) != 2))
    return language.predict(docs, model, ["doc_id"]).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(table(spark, sf_dir, "documents"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), ["doc_id"])

    def joined(kinds: tuple[str, ...]) -> Column:
        mine = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(mine, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("__keep.doc_id", *map(count, pii.BASE_KINDS), F.sha2(joined(pii.BASE_KINDS), 256).alias("base_sha256"), joined(pii.KINDS).alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("decimal(3,2)").cast("string")), ",").alias("scores"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), *vocabulary(), keep=["doc_id"], decode=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligned = alignment.align(table(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN, keep=["doc_id"], digest=True)
    return aligned.select("__keep.doc_id", *alignment.NUMBERS, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def looped(doc_id: Column, text: Column) -> Column:
    """Every tenth text, by crc32 of its doc_id, made periodic from some word on; the others as they are."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")

    def loop(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)).cast("long") + 1
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(at, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words, loop)).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs, keep=["doc_id"], digest=True)
    exponent = F.floor(1000 * F.col("length") / F.col("period")).cast("long").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "start", "length", "period", exponent, F.col("runs").alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), keep=["page_id"])
    return judged.select("__keep.page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad", "bound")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_near_dup, op3_quality_model, op4_toxicity, op5_quality_rules, op6_language, op7_licenses, op8_sharding, op9_pii, op10_bpe, op11_alignment, op12_periodic, op13_urls)}

_OP1_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS words
  FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (
  SELECT d.rid, d.i, d.size, win.item FROM (
    SELECT rid, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS words
    FROM doc, (SELECT DISTINCT size FROM win) AS s, unnest(range(1, greatest(len(w) - size + 2, 1))) AS t(i)) AS d
  JOIN win ON d.size = win.size AND d.words = win.words),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + size)) AS t(p) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM occ WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""


def _op5_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    verdict = " AND ".join(
        f"{r.measure} {sign} {bound}" for r in quality_rules.RULES for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None
    )
    return rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS words FROM doc, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) >= 3),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, words) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM twice, unnest([i, i + 1, i + 2]) AS t(p) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(l, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipsis_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word
  FROM doc LEFT JOIN rep USING (rid)),
r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0.0 END AS stop_word_ratio,
    CASE WHEN word_chars > 0 THEN n_digits / word_chars ELSE 0.0 END AS digit_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
    CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0.0 END AS ellipsis_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {verdict} AS kept FROM r"""


def _op7_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in licenses.KNOWN)

    def spelled(text: str) -> str:
        t = f"' ' || replace({text}, ' ', '  ') || ' '"
        for other, one in licenses.SPELLINGS:
            t = f"replace({t}, ' {other.replace(' ', '  ')} ', ' {one.replace(' ', '  ')} ')"
        return f"trim(replace({t}, '  ', ' '))"

    def lines(text: str) -> str:
        t = f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        each = f"list_transform(string_split({t}, chr(10)), lambda x: trim(x))"
        return f"list_filter({each}, lambda x: x != '' AND NOT (x LIKE 'c%' AND regexp_matches(x, {quote(licenses.COPYRIGHT)})) AND x != 'all rights reserved')"

    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256({spelled("array_to_string(l, ' ')")}) AS digest FROM (SELECT license_id, {lines("text")} AS l FROM (VALUES {known}) AS k(license_id, text)) WHERE len(l) > 0) GROUP BY digest),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {lines("text")} AS l FROM documents),
whole AS (SELECT rid, doc_id, CASE WHEN len(l) > 0 THEN sha256({spelled("array_to_string(l, ' ')")}) END AS text_sha256 FROM doc),
hit AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM (SELECT rid, sha256({spelled("x")}) AS digest FROM (SELECT rid, unnest(l) AS x FROM doc)) JOIN known USING (digest) GROUP BY rid)
SELECT doc_id, text_sha256, known.license_id AS text_license, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_license_lines, coalesce(ids, '') AS line_licenses
FROM whole LEFT JOIN hit USING (rid) LEFT JOIN known ON known.digest = text_sha256"""




def _op9_sql() -> str:
    near = lambda side, words: rf"regexp_matches({side}, '(?:^|[^\p{{L}}])(?:{words})(?:[^\p{{L}}]|$)')"
    either = lambda words: f"({near('lead', words)} OR {near('trail', words)})"
    score = " ".join(f"WHEN '{k}' THEN {pii.SCORES[k]} + CASE WHEN {either(pii.CONTEXT[k])} THEN {pii.RAISE} ELSE 0 END" for k in pii.KINDS)
    countries = "|".join(f"(?:{c})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in pii.BY_LENGTH.items())
    return rf"""
WITH RECURSIVE kind(kind, pattern, k, part) AS (VALUES
  ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', 1, 0), ('ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', 2, 0),
  ('card', '[0-9]([\x20-]?[0-9])+', 3, 0), ('phone', '\+[0-9][\x20().0-9-]+[0-9]', 4, 0),
  ('iban', '\b(?:{countries})\b', 5, 0), ('iban', '\b[A-Z]{{2}}[0-9]{{2}}(\x20?[A-Z0-9]){{11,30}}\b', 5, 1)),
doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
seen AS (SELECT rid, kind, k, part, pattern, CASE WHEN kind = 'iban' THEN replace(t, '_', '.') ELSE t END AS t FROM doc, kind),
raw AS (SELECT rid, kind, k, part, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS gap FROM seen),
step(rid, kind, k, part, m, gap, i, start, finish) AS (
  SELECT rid, kind, k, part, m, gap, 0, 0, 0 FROM raw WHERE len(m) > 0
  UNION ALL
  SELECT rid, kind, k, part, m, gap, i + 1, finish + length(gap[i + 1]), finish + length(gap[i + 1]) + length(m[i + 1]) FROM step WHERE i < len(m)),
span AS (SELECT rid, kind, k, part, start, finish, m[i] AS x, regexp_replace(m[i], '[^0-9]', '', 'g') AS d, replace(m[i], ' ', '') AS p FROM step WHERE i > 0),
luhn AS (
  SELECT *, list_sum(list_transform(range(0, length(d)), lambda j: CASE WHEN j % 2 = 0 THEN CAST(substr(d, length(d) - j, 1) AS INT)
    WHEN CAST(substr(d, length(d) - j, 1) AS INT) > 4 THEN 2 * CAST(substr(d, length(d) - j, 1) AS INT) - 9 ELSE 2 * CAST(substr(d, length(d) - j, 1) AS INT) END)) AS s,
    list_reduce(list_prepend(CAST(0 AS BIGINT), CASE WHEN kind = 'iban' THEN list_transform(range(4, 4 + length(p)), lambda j: CAST(ascii(substr(p, j % length(p) + 1, 1)) AS BIGINT)) ELSE [] END),
      lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) AS r FROM span),
sure AS (
  SELECT * FROM luhn WHERE kind = 'email' OR (kind = 'ip' AND len(list_filter(string_split(x, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT), 256) > 255)) = 0)
    OR (kind = 'card' AND length(d) BETWEEN 16 AND 19 AND s % 10 = 0) OR (kind = 'phone' AND length(d) BETWEEN 8 AND 15)
    OR (kind = 'iban' AND length(p) BETWEEN 15 AND 34 AND r = 1)),
sided AS (SELECT sure.*, lower(substr(t, greatest(start - {pii.BEFORE}, 0) + 1, start - greatest(start - {pii.BEFORE}, 0))) AS lead, lower(substr(t, finish + 1, {pii.AFTER})) AS trail FROM sure JOIN doc USING (rid)),
scored AS (SELECT *, CAST(CASE kind {score} END - CASE WHEN {either(pii.LOWERING)} THEN {pii.LOWER} ELSE 0 END AS DECIMAL(3, 2)) AS score FROM sided),
enough AS (SELECT * FROM scored WHERE kind <> 'iban' OR score >= {pii.LEAST}),
good AS (SELECT * FROM enough AS a WHERE part = 0 OR NOT EXISTS (SELECT 1 FROM enough AS b WHERE b.rid = a.rid AND b.kind = 'iban' AND b.part = 0 AND b.start < a.finish AND a.start < b.finish)),
base AS (
  SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY k, start) FILTER (kind <> 'iban') AS base_spans,
    string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY k, start) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, start) AS scores FROM good GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM doc LEFT JOIN base USING (rid)"""


def _op13_sql() -> str:
    longest = sorted(urls.RULES, key=lambda r: -len(r.host + r.path))
    fits = [f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')" for r in longest]
    rule, verdict = ("CASE " + " ".join(f"WHEN {f} THEN '{value(r)}'" for f, r in zip(fits, longest, strict=True)) + " END" for value in (lambda r: r.host + r.path, lambda r: r.verdict))
    double = ", ".join(f"'{s}'" for s in urls.DOUBLE_SUFFIXES)

    def strength(level: str) -> str:
        v, most = "prior * (1 - prior)", urls.STRONGEST
        return f"""(SELECT CASE WHEN coalesce(m, 0) = 0 OR coalesce(b, 0) <= 0 THEN {most} ELSE least({most}, greatest({urls.WEAKEST}, m / b - 1)) END FROM (
          SELECT sum(n * (bad / n - prior) * (bad / n - prior) - {v}) AS b, sum((n - 1) * {v}) AS m FROM {level} WHERE n > 1))"""

    return rf"""
WITH page AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM page),
ruled AS (SELECT *, {rule} AS rule, {verdict} AS by_rule FROM cut),
named AS (SELECT host, count(*) AS n_rows, count(by_rule) AS n, count(*) FILTER (by_rule = 'block') AS bad, string_split(regexp_replace(string_split(host, '@')[-1], ':[0-9]*$', ''), '.') AS l FROM ruled GROUP BY host),
hosts AS (SELECT host, n_rows, n, bad, array_to_string(list_slice(l, CASE WHEN array_to_string(l[-2:], '.') IN ({double}) THEN -3 ELSE -2 END, -1), '.') AS domain,
  CASE WHEN array_to_string(l[-2:], '.') IN ({double}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM named),
domains AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain),
l1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM domains) AS prior FROM domains GROUP BY suffix),
p1 AS (SELECT suffix, (bad + k * prior) / (n + k) AS prior FROM l1, (SELECT {strength("l1")} AS k)),
l2 AS (SELECT domain, n, bad, prior FROM domains JOIN p1 USING (suffix)),
p2 AS (SELECT domain, (bad + k * prior) / (n + k) AS prior FROM l2, (SELECT {strength("l2")} AS k)),
l3 AS (SELECT host, n, bad, prior FROM hosts JOIN p2 USING (domain)),
p3 AS (SELECT host, n, bad, (bad + k * prior) / (n + k) AS mean, k FROM l3, (SELECT {strength("l3")} AS k)),
known AS (SELECT host, CAST(n AS BIGINT) AS n_labelled, CAST(bad AS BIGINT) AS n_bad, round(mean - {urls.Z} * sqrt(mean * (1 - mean) / (n + k + 1)), 6) AS bound FROM p3)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN bound > {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_labelled, n_bad, bound
FROM ruled JOIN known USING (host)"""


ORACLE_SQL: dict[str, str] = {"op1_decontaminate": _OP1_SQL, "op5_quality_rules": _op5_sql(), "op7_licenses": _op7_sql(), "op9_pii": _op9_sql(), "op13_urls": _op13_sql()}
