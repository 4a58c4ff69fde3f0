"""Personal data: regular expressions propose spans, checksums confirm, context scores.

Kinds email, ip, card (16 to 19 digits passing Luhn), phone (8 to 15 digits)
and iban (mod 97 leaves 1; of the length of its country, or of any length where
that finds none).  Every span has a score: that of its kind, more if a word of its
kind stands near, less if a word says it is something else.  The first four kinds
are reported whatever their score; an iban counts from ``LEAST`` on.  Offsets are code points, end exclusive.  Matches
are leftmost and do not overlap within a kind; one that fails its check is
dropped and its characters are not searched again.  Everything is built-in
functions over one row: no shuffle, no user function.

Offsets come from the pieces that ``split`` leaves between matches, added up in
blocks, so time grows with the text and its spans, not with their product.  The
patterns are written so that none backtracks over a long run: a match can only
begin where a run of its first character class does.

Defined results: null and empty texts have no spans; repeated rows have
repeated spans; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.batches import let

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
#: Length of an account number by country.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BI=27, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DJ=27, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FK=18, FO=18, FR=27, GB=22, GE=22, GI=23,
    GL=18, GR=27, GT=28, HN=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MN=20, MR=27, MT=31, MU=30, NI=28,
    NL=18, NO=15, OM=23, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, RU=33, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, SO=23, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20, YE=30,
)
BY_LENGTH = {n: "|".join(c for c, m in IBAN_LENGTHS.items() if m == n) for n in sorted(set(IBAN_LENGTHS.values()))}
#: An account number of its country's length: what follows after a space is left alone.
IBAN_OF_LENGTH = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in BY_LENGTH.items()) + r")(?![A-Za-z0-9])"
#: A text without these can't match: a cheap test before the pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

# Score of a confirmed span, words that raise it, and words that lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.75}
CONTEXT = {
    "email": "mail|e-mail|email|contact|courriel|correo",
    "ip": "ip|host|server|address|addr|login",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|tél|teléfono",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
LOWERING = "example|sample|dummy|fake|test|invalid|invoice no|order no|serial|part no"
RAISE, LOWER, BEFORE, AFTER = 0.1, 0.3, 40, 20
#: Added kinds with a lower score are left out.
LEAST = 0.5
#: Values of a block whose running values are folded together, and code points of a chunk of text.
BLOCK, CHUNK = 256, 2048
FAR = 2**31 - 1


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _mod97(iban: Column) -> Column:
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(total: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (total * 10 + c - 48) % 97).otherwise((total * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    plain = F.translate(m, " -().+", "")
    if kind == "card":
        return F.when(F.length(plain).between(16, 19), _luhn(plain)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(plain).between(8, 15)
    return F.when(F.length(plain).between(15, 34), _mod97(plain)).otherwise(F.lit(False))


# --- long texts -----------------------------------------------------------------
#
# A text with many spans takes time in proportion to both: running values are
# folded in blocks (a list that grows is copied at each step), and pieces of text come from
# CHUNK-wide chunks (a substring walks the text from its begin).


def prefix(values: Column, add: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each of ``values`` what ``add`` makes of all before it; ``add`` is associative."""
    none = F.array().cast("array<int>")

    def running(items: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(items, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def in_blocks(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        blocks = F.transform(places, lambda k: F.slice(v, k * BLOCK + 1, BLOCK))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, running(F.transform(b, lambda x: F.aggregate(x, zero, add)), zero), running)))

    return let(values, lambda v: F.when(F.size(v) > 0, in_blocks(v)).otherwise(none))


def _greatest(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def _least(x: Column, y: Column) -> Column:
    return F.least(x, y)


def chunks_of(text: Column) -> Column:
    """The text in chunks of CHUNK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut_out(chunks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in chunks."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    head = F.coalesce(F.substring(F.get(chunks, first), start % CHUNK + 1, F.least(end - start, F.lit(CHUNK))), F.lit(""))
    tail = F.coalesce(F.substring(F.get(chunks, last), F.lit(1), end % CHUNK), F.lit(""))
    return F.when(first == last, head).otherwise(F.concat(head, F.array_join(F.slice(chunks, first + 2, last - first - 1), ""), tail))


def _score(kind: str, chunks: Column, start: Column, end: Column) -> Column:
    before, after = F.lower(cut_out(chunks, F.greatest(start - BEFORE, F.lit(0)), start)), F.lower(cut_out(chunks, end, end + AFTER))

    def near(words: str, change: float) -> Column:
        found = rf"(?:^|[^\p{{L}}])(?:{words})(?:[^\p{{L}}]|$)"
        return F.when(before.rlike(found) | after.rlike(found), F.lit(change)).otherwise(F.lit(0.0))

    return F.round(F.lit(SCORES[kind]) + near(CONTEXT[kind], RAISE) - near(LOWERING, LOWER), 2)


def _spans(kind: str, text: Column, pattern: str | None = None) -> Column:
    """The confirmed spans of a kind in a text, as one expression.

    Matches and the pieces between them are bound by ``let``, so that a filter
    which Spark moves below this expression doesn't find them anew for each match.
    """
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    pattern = pattern or PATTERNS[kind]

    def placed(m: Column, g: Column) -> Column:
        steps = F.zip_with(F.slice(g, 1, F.size(m)), m, lambda gap, match: F.length(gap) + F.length(match))
        each = lambda at, i: F.struct((at + F.length(F.get(g, i))).alias("start"), F.get(m, i).alias("match"))
        return F.filter(F.transform(prefix(steps, lambda x, y: x + y, F.lit(0)), each), lambda x: _confirmed(kind, x["match"]))

    def scored(found: Column) -> Column:
        def span(c: Column, x: Column) -> Column:
            end = x["start"] + F.length(x["match"])
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), end.alias("end"), _score(kind, c, x["start"], end).alias("score"))

        return let(found, lambda f: F.when(F.size(f) > 0, let(chunks_of(text), lambda c: F.transform(f, lambda x: span(c, x)))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind in NEEDS:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found)
    some = let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern), lambda g: scored(placed(m, g)))))
    some = F.coalesce(some, empty)
    return some if kind in BASE_KINDS else F.filter(some, lambda s: s["score"] >= LEAST)


def _accounts(text: Column) -> Column:
    """Numbers of their country's length, and those of the open pattern that overlap none of these."""

    def both(sure: Column) -> Column:
        tagged = lambda spans, open_: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(open_).alias("open"), s.alias("span")))
        ordered = F.array_sort(F.concat(tagged(sure, False), tagged(_spans("iban", text), True)))
        return F.when(F.size(sure) > 0, let(ordered, apart)).otherwise(_spans("iban", text))

    def apart(o: Column) -> Column:
        before = prefix(F.transform(o, lambda x: F.when(x["open"], 0).otherwise(x["span"]["end"])), _greatest, F.lit(0))
        after = prefix(F.reverse(F.transform(o, lambda x: F.when(x["open"], FAR).otherwise(x["start"]))), _least, F.lit(FAR))
        free = lambda b, a, x: ~x["open"] | ((F.get(b, x["nth"]) <= x["start"]) & (F.get(a, F.size(a) - 1 - x["nth"]) >= x["span"]["end"]))
        numbered = F.transform(o, lambda x, i: F.struct(x["start"].alias("start"), x["open"].alias("open"), x["span"].alias("span"), i.alias("nth")))
        return let(before, lambda b: let(after, lambda a: F.transform(F.filter(numbered, lambda x: free(b, a, x)), lambda x: x["span"])))

    return let(_spans("iban", text, IBAN_OF_LENGTH), both)


def find_pii(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns (under ``__keep``), the text (``__t``) and ``spans``: an array of
    (kind, start, end, score), by kind in the order of KINDS, then by start."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__keep"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    return out.select("__keep", "__t", F.concat(*[_accounts(F.col("__t")) if k == "iban" else _spans(k, F.col("__t")) for k in KINDS]).alias("spans"))


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span, or union of overlapping spans, replaced by its first one's ``<KIND>``.

    ``n_chars``, if there is such a column, is counted anew where the text changed.
    """
    found = find_pii(docs, docs.columns, text)
    t = F.col("__t")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def clean_text(o: Column, upto: Column, c: Column) -> Column:
        """What stands before each span that begins behind all before it, and its name."""
        fresh = F.filter(F.zip_with(o, upto, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda x: x["start"] >= x["at"])
        parts = F.transform(fresh, lambda x: F.concat(cut_out(c, x["at"], x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), cut_out(c, F.array_max(F.transform(o, lambda s: s["end"])), F.length(t)))

    done = let(ordered, lambda o: let(prefix(F.transform(o, lambda s: s["end"]), _greatest, F.lit(0)), lambda upto: let(chunks_of(t), lambda c: clean_text(o, upto, c))))
    found = found.withColumn("__clean", F.when(F.size("spans") > 0, done))
    clean = F.coalesce(F.col("__clean"), F.col("__keep")[text])
    columns = []
    for c in docs.columns:
        old = F.col("__keep")[c]
        if c == text:
            columns.append(clean.alias(c))
        elif c == n_chars:
            columns.append(F.when(F.col("__clean").isNotNull(), F.length("__clean").cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            columns.append(old.alias(c))
    return found.select(*columns)
