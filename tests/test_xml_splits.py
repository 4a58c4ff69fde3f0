"""XML rows against a scan of the whole text letter by letter, for splits of any size."""

import random

import pytest
from loomlog.sources import xml_splits
from loomlog.sources.xml_splits import read_xml_rows


def plain_rows(text, row):
    """The outermost elements called ``row``, found letter by letter."""
    out, i, depth, start = [], 0, 0, None
    while i < len(text):
        if text[i] != "<":
            i += 1
            continue
        for opening, ending in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>")):
            if text.startswith(opening, i):
                end = text.find(ending, i + len(opening))
                i = len(text) if end < 0 else end + len(ending)
                break
        else:
            if text.startswith("<!", i):
                end = text.find("]>", i) if "[" in text[i : text.find(">", i)] else text.find(">", i) - 1
                i = end + 2
                continue
            j, quote = i + 1, None
            while j < len(text) and (quote or text[j] != ">"):
                quote = None if text[j] == quote else quote or (text[j] if text[j] in "\"'" else None)
                j += 1
            tag = text[i : j + 1]
            name = tag[1:-1].strip("/").split()[0] if tag[1:-1].strip("/").split() else ""
            if name.rstrip("/") == row:
                if tag.startswith("</"):
                    depth = max(depth - 1, 0)
                    if depth == 0 and start is not None:
                        out.append(text[start : j + 1])
                        start = None
                elif tag.endswith("/>"):
                    if not depth:
                        out.append(tag)
                else:
                    if not depth:
                        start = i
                    depth += 1
            i = j + 1
    return out


def made(rng, n):
    """A document with everything that may hold a row's tags or a ``>`` without meaning it."""
    value = lambda: rng.choice(["a", "x > y", "<!-- no -->", "'", "<E>", "1/", "é"])
    quoted = lambda: (lambda v: f'"{v}"' if "'" in v or rng.random() < 0.5 else f"'{v}'")(value())
    attrs = lambda: "".join(f" a{i}={quoted()}" for i in range(rng.randrange(3)))

    def inner(depth):
        kind = rng.randrange(9)
        if kind == 0:
            return f"<!-- <E> {rng.choice(['', '> >', '</E>'])} -->"
        if kind == 1:
            return "<![CDATA[ </E> <E a='1'> ]] > ]]>"
        if kind == 2 and depth < 3:
            return f"<E{attrs()}>{inner(depth + 1)}</E >"
        if kind == 3:
            return f"<Ex{attrs()}>text &gt; > </Ex>"
        if kind == 4:
            return f"<E{attrs()}/>"
        if kind == 5:
            return "<?pi a > <E> ?>"
        return f"<x{attrs()}>{rng.choice(['', 'é中', 'a > b'])}</x>"

    rows = [rng.choice([f"<E{attrs()}>{''.join(inner(0) for _ in range(rng.randrange(4)))}</E>", f"<E{attrs()}/>", f"<E{attrs()} />", inner(3), " text > ", "\n"]) for _ in range(n)]
    body = "".join(rows)
    return rng.choice([body, f'<?xml version="1.0"?>\n<Root a=">">{body}</Root>\n', f"<!DOCTYPE r [ <!ENTITY e '>'> ]><r>{body}</r>", f"</E>{body}<E>never closed"])


@pytest.mark.parametrize("split", [40, 333, 5000, 10_000_000])
def test_rows_do_not_depend_on_splits(spark, tmp_path, split):
    rng, want = random.Random(3), []
    for i in range(6):
        text = made(rng, 60)
        (tmp_path / f"f{i}.xml").write_bytes((b"\xef\xbb\xbf" if i == 2 else b"") + text.encode())
        want += [(f"f{i}.xml", x) for x in plain_rows(text, "E")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = [(r.file.rsplit("/", 1)[1], r.xml) for r in read_xml_rows(spark, str(tmp_path), "E").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(got) == sorted(want) and len(want) > 100


def test_summaries_of_any_split_compose():
    """Running a text in two halves, the second from where the first ends, equals running it whole."""
    rng = random.Random(8)
    machine = xml_splits.Machine("E")
    for _ in range(60):
        pieces = made(rng, 12).split(">")
        cut = rng.randrange(len(pieces))
        parts = []
        for half in (pieces[:cut], pieces[cut:], pieces):
            summary = xml_splits._Summary(machine)
            for p in half:
                summary.add(p)
            parts.append(summary.row())
        (e1, c1, o1), (e2, c2, o2), (e, c, o) = parts
        for s in xml_splits.STATES:
            mid = e1[s]
            for depth in range(4):
                at = max(max(depth - c1[s], 0) + o1[s] - c2[mid], 0) + o2[mid]
                assert (e[s], max(depth - c[s], 0) + o[s]) == (e2[mid], at)


def test_a_file_of_rows_without_content_splits(spark, tmp_path):
    (tmp_path / "a.xml").write_text("".join(f'<E id="{i}"/>' for i in range(20_000)))  # no line end
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        got = read_xml_rows(spark, str(tmp_path / "a.xml"), "E")
        assert xml_splits._pieces(spark, [str(tmp_path / "a.xml")], {}).rdd.getNumPartitions() > 5
        assert sorted(int(r.xml[7:-3]) for r in got.collect()) == list(range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
