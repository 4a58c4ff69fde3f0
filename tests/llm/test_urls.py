"""URL filter: parts and rules on odd urls, shrinkage against plain arithmetic, hot hosts."""

import math
import re

from loomlog.llm import urls
from pyspark.sql import functions as F

ODD = [
    (1, "http://WWW.Example.ORG/es/1?x=/en/1", "www.example.org", "/es/1", "example.org/es/", "block"),
    (2, "https://example.org/en/12#top", "example.org", "/en/12", "example.org/en/1", "block"),
    (3, "https://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"),
    (4, "ftp://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
    (5, "http://a.com/fr", "a.com", "/fr", None, None),
    (6, "http://org", "org", "", None, None),
    (7, "http://x.net?u=http://y.org/", "x.net", "", None, None),
    (8, None, "", "", None, None),
    (9, "", "", "", None, None),
    (10, "no scheme.org/", "", "", None, None),
    (11, "://", "", "", None, None),
    (12, "a\nb://É.Com/de/x", "É.com", "/de/x", "com/de/", "block"),
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u, *_ in ODD], "page_id int, url string, host string")
    got = {r["__keep"].page_id: r for r in urls.judge(pages).collect()}
    for i, _, host, path, rule, verdict in ODD:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
        assert got[i].verdict == (verdict or got[i].verdict) and got[i]["__keep"].host == "clash"
    assert len(got) == len(ODD)


def test_domains(spark):
    names = ["a.b.example.com", "b.co.uk", "x.b.co.uk:80", "me@c.net", "org", "", "co.uk"]
    got = spark.createDataFrame([(n,) for n in names], "host string").select(urls.domain_of(F.col("host")), urls.suffix_of(F.col("host"))).collect()
    assert list(map(tuple, got)) == [("example.com", "com"), ("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("c.net", "net"), ("org", "org"), ("", ""), ("co.uk", "co.uk")]


def plain(pages):
    """{host: (n, bad, bound)} by loops over dictionaries."""
    hosts = {}
    for host, bad in pages:
        n, b = hosts.get(host, (0, 0))
        hosts[host] = (n + (bad is not None), b + bool(bad))
    up = lambda h: ".".join(h.split(".")[-2:])
    levels = [hosts]
    for f in (up, lambda h: h.split(".")[-1], lambda h: ""):
        level = {}
        for name, (n, b) in levels[-1].items():
            m, c = level.get(f(name), (0, 0))
            level[f(name)] = (m + n, c + b)
        levels.append(level)
    n, b = levels[3][""]
    prior, out = {"": (b + 1) / (n + 2)}, {}
    for level, f in ((levels[2], lambda h: ""), (levels[1], lambda h: h.split(".")[-1]), (levels[0], up)):
        beyond = sum(n * (b / n - prior[f(h)]) ** 2 - prior[f(h)] * (1 - prior[f(h)]) for h, (n, b) in level.items() if n > 1)
        most = sum((n - 1) * prior[f(h)] * (1 - prior[f(h)]) for h, (n, b) in level.items() if n > 1)
        k = urls.STRONGEST if not most or beyond <= 0 else min(urls.STRONGEST, max(urls.WEAKEST, most / beyond - 1))
        prior, before = {h: (b + k * prior[f(h)]) / (n + k) for h, (n, b) in level.items()}, prior
        out = {h: (n, b, prior[h] - urls.Z * math.sqrt(prior[h] * (1 - prior[h]) / (n + k + 1))) for h, (n, b) in level.items()}
    return out


def test_reputations_equal_plain_arithmetic(spark):
    """A host with a third of all pages, hosts that are all bad, hosts without labels."""
    rows = [("hot.a.com", i % 40 == 0 if i % 3 else None) for i in range(3000)]
    rows += [(f"bad{j}.spam.net", True) for j in range(40) for _ in range(30)] + [(f"h{j}.a.com", (i * j) % 11 == 1) for j in range(300) for i in range(1 + j % 20)]
    rows += [(f"new{j}.spam.net", None) for j in range(3)] + [("new.a.com", None), ("", None), ("lone.org", True)]
    got = {r.host: r for r in urls.reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for host, (n, bad, bound) in want.items():
        assert (got[host].n, got[host].n_bad) == (n, bad) and abs(got[host].bound - bound) < 1e-6, host
    blocked = {h for h, r in got.items() if r.bound > urls.LIMIT}
    assert {f"bad{j}.spam.net" for j in range(40)} <= blocked and not any(re.search(r"a\.com$", h) for h in blocked)
    assert "lone.org" not in blocked  # one bad page doesn't convict


def test_labels_of_the_caller_and_empty_table(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.net/{i}", i % 2) for i in range(400)], "page_id int, url string, junk int")
    got = urls.judge(pages, rules=(), bad=F.when(F.col("page_id") < 200, F.col("junk") == 1), keep=["page_id"])
    assert {(r.host, r.verdict) for r in got.collect()} == {("bad.net", "block"), ("good.net", "allow")}
    assert urls.judge(pages.limit(0)).count() == 0
