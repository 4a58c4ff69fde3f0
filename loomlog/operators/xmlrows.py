"""XML rows: which element repeats, and rows flattened to dotted paths."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.fields import named
from loomlog.functions.times import iso
from loomlog.operators.blocks import first_timestamp
from loomlog.operators.lines import FORMAT, TIMESTAMP
from loomlog.operators.rules import XML_RULES, XmlRule

TEXT = "_VALUE"
MIN_SIBLINGS = 3
TAG = r"<(?:[!?][^>]*|/?[A-Za-z_][\w:.-]*(?:\s[^<>]*?)?/?)>"


ROW_ELEMENT = "row string, siblings long, depth long"
_tags = re.compile(TAG, re.ASCII).findall
_name = re.compile(r"</?([\w:.-]+)", re.ASCII).match


def row_element(head: str) -> tuple[str, int, int] | None:
    """(name, siblings, depth) of one head's row element, None where none has MIN_SIBLINGS."""
    depth, last, counts = 0, {}, Counter()
    for pos, tag in enumerate(_tags(head)):
        if tag.startswith(("<!", "<?")):
            continue
        if tag.startswith("</"):
            depth -= 1
            continue
        # an element's parent is the last one that opened a level above
        counts[last.get(depth - 1), _name(tag)[1], depth] += 1
        last[depth] = pos
        depth += not tag.endswith("/>")
    best = min(((-n, at, name) for (_, name, at), n in counts.items() if n >= MIN_SIBLINGS), default=None)
    return best and (best[2], -best[0], best[1])


def row_elements(heads: DataFrame, file: str = "file", head: str = "head") -> DataFrame:
    """(file, row, siblings, depth): the element with the most siblings of its name under one parent.

    At least MIN_SIBLINGS of them; ties go to the smaller depth, then name.
    ``head`` is the beginning of a document, one row a file; its tags are counted
    where it stands, so a task holds one head at a time.
    """
    found = F.udf(lambda x: row_element(x), ROW_ELEMENT)(F.col(head))
    rows = heads.filter(F.col(head).isNotNull()).select(F.col(file).alias("file"), found.alias("b"))
    return rows.filter("b IS NOT NULL").select("file", "b.row", "b.siblings", "b.depth")


def leaves(kind: T.DataType, path: str = "") -> list[tuple[str, Callable[[Column], Column], bool]]:
    """(dotted path, function from the value to the leaf, is it a list?) of all text below a value.

    Attributes are ``path.@name``, an element's own text stands under its path.
    Below an element that repeats, each leaf is one list over all repetitions.
    """
    if isinstance(kind, T.StructType):
        out = []
        for field in kind:
            here = path if field.name == TEXT else f"{path}.{field.name}" if path else field.name
            for p, leaf, many in leaves(field.dataType, here):
                out.append((p, lambda c, name=field.name, leaf=leaf: leaf(c.getField(name)), many))
        return [x for x in out if x[0]]
    if isinstance(kind, T.ArrayType):
        return [(p, lambda c, leaf=leaf, many=many: _listed(c, leaf, many), True) for p, leaf, many in leaves(kind.elementType, path)]
    return [(path, (lambda c: F.nullif(F.trim(c), F.lit(""))) if isinstance(kind, T.StringType) else (lambda c: c), False)]


def _listed(items: Column, leaf: Callable[[Column], Column], many: bool) -> Column:
    each = F.transform(items, lambda x: leaf(x))  # leaf has parameters bound
    if many:
        each = F.flatten(F.filter(each, lambda x: x.isNotNull()))
    return F.filter(each, lambda x: x.isNotNull())


def infer_schema(rows: DataFrame, options: dict[str, str]) -> T.StructType:
    """Every element and attribute of all ``rows`` (one column of XML): schemas of rows, merged on the executors."""
    spark = rows.sparkSession
    known = rows.select(F.col(rows.columns[0]).cast("string").alias("value")).filter("value IS NOT NULL")
    texts = getattr(known._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    read = spark.read.options(**options, samplingRatio="1.0", columnNameOfCorruptRecord="__corrupt")._jreader.xml(texts)
    schema = T.StructType.fromJson(json.loads(read.schema().json()))
    return T.StructType([f for f in schema if f.name != "__corrupt"])


def parse_xml_rows(rows: DataFrame, row: str, schema: T.StructType | str | None = None, xml: str = "xml", rule: XmlRule = XML_RULES[0]) -> DataFrame:
    """``rows`` parsed and flattened, with timestamp and format.

    Without a schema it is inferred from all rows, by a pass of its own.  Entities are
    decoded once; markup inside them stays text.
    """
    options = {"attributePrefix": "@", "valueTag": TEXT, "inferSchema": "false", "rowTag": row}
    if schema is None:
        schema = infer_schema(rows.select(xml), options)
    parsed = rows.withColumn("__row", F.from_xml(xml, schema if isinstance(schema, str) else _ddl(schema), options))
    flat = leaves(parsed.schema["__row"].dataType)
    out = parsed.select(*[c for c in rows.columns if c != xml], *[leaf(F.col("__row")).alias(p) for p, leaf, _ in flat])
    lists = {p: many for p, _, many in flat}
    candidates = [F.try_element_at(named(c), F.lit(1)) if lists[c] else named(c) for c in rule.ts_candidates if c in lists]
    ts = first_timestamp(candidates, rule.ts_layouts) if candidates else F.lit(None).cast("timestamp")
    return out.withColumn(TIMESTAMP, iso(ts)).withColumn(FORMAT, F.lit(f"xml:{row}"))


def _ddl(schema: T.StructType) -> Column:
    return F.lit(schema.json())
