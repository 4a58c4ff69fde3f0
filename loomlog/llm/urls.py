"""URL filter: explicit rules first, then empirical-Bayes reputation of the host.

A page has a labelled outcome where something says whether it is bad: a column
of the caller, or a rule of the filter.  Outcomes are counted by host, and
hosts' rates are shrunk through beta-binomial priors: the suffix's rate towards
that of all pages, the registered domain's towards its suffix's, the host's
towards its domain's.  A level's strength k (how many outcomes its prior is worth) is
estimated from how far the level's rates lie from their priors beyond what
binomial noise explains, by moments.  A host is blocked if its bad rate is over ``limit``
at the posterior's lower bound: mean - z standard deviations, which is below
the true rate with probability 1 - 1 / (1 + z^2) or more for any posterior
(Cantelli).

The rows that hosts share (one host may have a third of all pages) are counted
by partial aggregates.  Reputations go back to pages by a join that broadcasts
the keys with over 1 / HOT of all rows, of which there are fewer than HOT, and
shuffles the others.

Defined results: a null url, and one without ``://``, has an empty host and path;
such pages share the reputation of the empty host.  A host without labelled
pages has its domain's mean, and so on up.  Without any label nothing is
blocked.  Repeated rows count each; other columns are kept if asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.batches import cut

#: Keys with over 1 / HOT of the rows are broadcast.
HOT = 500
#: A host is blocked if its bad rate is over LIMIT even Z standard deviations below the mean.
LIMIT, Z = 0.5, 1.0
#: Bounds of a prior's strength; at the lower one a single bad page does not yet block its host.
WEAKEST, STRONGEST = 4.0, 1000.0
#: Suffixes of two labels under which domains are registered; all others have one label.
DOUBLE_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "org.uk")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Verdict for a host with its subdomains, below a path's beginning."""

    verdict: str
    host: str
    path: str


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The public suffix; user names and ports don't count."""
    name = F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    name = F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def matched(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits, the earlier of two as long; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def look_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row a key; n_rows of the key's rows, of ``total``).

    Fewer than HOT keys can have over 1 / HOT of the rows: these are broadcast.
    """
    is_hot = F.col("n_rows") * HOT > total
    hot = table.filter(is_hot).withColumn("__hot", F.lit(True))
    tagged = rows.join(F.broadcast(hot), key, "left")
    near, far = tagged.filter("__hot").drop("__hot"), tagged.filter("__hot IS NULL").select(*rows.columns)
    return near.unionByName(far.join(table.filter(~is_hot), key, "left"))


def _strength(level: DataFrame) -> float:
    """How many outcomes the prior of a level is worth; ``level``: n, bad, prior."""
    v = F.col("prior") * (1 - F.col("prior"))
    off = F.col("bad") / F.col("n") - F.col("prior")
    found = level.filter("n > 1").agg(F.sum(F.col("n") * off * off - v).alias("beyond"), F.sum((F.col("n") - 1) * v).alias("most")).first()
    if not found.most or found.beyond is None or found.beyond <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, found.most / found.beyond - 1))


def reputations(pages: DataFrame) -> DataFrame:
    """Of ``pages`` (host, bad: boolean, null where not labelled): a row a host.

    host, domain, suffix, n_rows, n (labelled), n_bad, rate (posterior mean), bound
    (its lower bound, rounded to six places so that equal counts compare equal).
    """
    counts = pages.groupBy("host").agg(F.count("*").alias("n_rows"), F.count("bad").alias("n"), F.count_if(F.col("bad")).alias("bad"))
    hosts = cut(counts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    sums = [F.sum(c).alias(c) for c in ("n", "bad")]
    domains = cut(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.count("*").alias("n_rows"), *sums))
    suffixes = cut(domains.groupBy("suffix").agg(F.count("*").alias("n_rows"), *sums))
    n, bad, n_domains = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    n_hosts = domains.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]

    def shrunk(level: DataFrame, k: float) -> Column:
        return (F.col("bad") + F.lit(k) * F.col("prior")) / (F.col("n") + F.lit(k))

    level = suffixes.withColumn("prior", F.lit((bad + 1) / (n + 2)))
    above = level.select("suffix", "n_rows", shrunk(level, _strength(level)).alias("prior"))
    level = look_up(domains.withColumnRenamed("n_rows", "n_hosts"), above, "suffix", n_domains).drop("n_rows")
    above = level.select("domain", F.col("n_hosts").alias("n_rows"), shrunk(level, _strength(level)).alias("prior"))
    level = look_up(hosts.withColumnRenamed("n_rows", "n_pages"), above, "domain", n_hosts).drop("n_rows")
    k = _strength(level)
    mean = shrunk(level, k)
    sd = F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(k) + 1))
    return level.select("host", "domain", "suffix", F.col("n_pages").alias("n_rows"), "n", F.col("bad").alias("n_bad"), F.round(mean, 6).alias("rate"), F.round(mean - Z * sd, 6).alias("bound"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", bad: Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) as __keep, host, path, rule, verdict, n_labelled, n_bad, bound.

    verdict: the longest rule's, else ``block`` where the bound of the host's bad rate
    is over LIMIT.  ``bad``: a boolean of the labelled pages, null on others; by
    default the rules' own verdicts are the labelled outcomes.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in (pages.columns if keep is None else keep)]).alias("__keep")
    at = F.col(f"`{url}`").cast("string")
    rule, verdict = matched(rules, host_of(at), path_of(at))
    outcome = (verdict == "block") if bad is None else bad
    seen = pages.select(kept, host_of(at).alias("host"), path_of(at).alias("path"), rule.alias("rule"), verdict.alias("by_rule"), outcome.alias("bad"))
    hosts = cut(reputations(seen.select("host", "bad")))
    total = hosts.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    out = look_up(seen.drop("bad"), hosts.select("host", "n_rows", "n", "n_bad", "bound"), "host", total)
    by_host = F.when(F.col("bound") > LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("__keep", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), F.col("n").alias("n_labelled"), "n_bad", "bound")
