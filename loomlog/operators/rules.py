"""Declarative parsing rules: line, block and XML families, checked before any job runs."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from loomlog.functions.times import LAYOUT_PIECES

DEFAULT_PRIORITY = {"line": 10, "block": 70, "xml": 80}
GROUP = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")


@dataclass(frozen=True)
class LineRule:
    """``parse`` has named groups, ``ts`` among them; only lines that match it open a record."""

    name: str
    parse: str
    ts_layout: str
    priority: int = 10
    ts_assume_tz: str = "UTC"
    ts_regex_subs: tuple[tuple[str, str], ...] = ()
    ts_use_mtime_date: bool = False
    ts_use_mtime_year: bool = False
    message_field: str = "message"

    @property
    def groups(self) -> list[str]:
        return GROUP.findall(self.parse)

    @property
    def pattern(self) -> str:
        """For Java: names are dropped, groups keep their numbers."""
        return GROUP.sub("(", self.parse)


@dataclass(frozen=True)
class BlockRule:
    """Records between lines that match ``separator``; ``field`` has the groups key and value."""

    name: str
    separator: str
    field: str
    sniff: str = ""
    priority: int = 70
    ts_field: tuple[str, ...] = ()
    ts_layouts: tuple[str, ...] = ()

    @property
    def field_pattern(self) -> str:
        return GROUP.sub("(", self.field)


@dataclass(frozen=True)
class XmlRule:
    """Timestamps of XML rows: the first of ``ts_candidates`` that reads by one of ``ts_layouts``."""

    name: str
    sniff: str = r"^\s*<"
    priority: int = 80
    ts_candidates: tuple[str, ...] = ()
    ts_layouts: tuple[str, ...] = ()


# The shipped formats.
LINE_RULES = (
    LineRule("iso-bracket", r"^(?P<ts>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) \[(?P<level>\w+)\] \[(?P<component>\w+)\] \[PID:(?P<pid>\d+)\] (?P<message>.*)$", "2006-01-02 15:04:05.000", 100),
    LineRule("dashdate-level", r"^(?P<ts>\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}\.\d{3})\s+(?P<level>\w+)\s+(?P<message>.*)$", "02-01-2006 15:04:05.000", 90),
    LineRule("dotdate-pidtid", r"^(?P<source>[\w.]+):\s+(?P<ts>\d{2}\.\d{2}\.\d{2}\s+\d{2}:\d{2}:\d{2}:\d+)\s+(?P<pid>\d+)/(?P<tid>\d+)\s+(?P<message>.*)$", "02.01.06 15:04:05.000", 90, ts_regex_subs=((r"(\d{2}:\d{2}:\d{2}):(\d+)$", "$1.$2"),)),
    LineRule("time-pidtid", r"^(?P<ts>\d{2}:\d{2}:\d{2}\.\d+)\s+(?P<pid>\d+)/(?P<tid>\d+)\s+(?P<level>\w+)\s+(?P<message>.*)$", "15:04:05.999999999", 80, ts_use_mtime_date=True),
    LineRule("time-dotdate", r"^(?P<ts>\d{2}:\d{2}:\d{2}\.\d{3} \d{2}\.\d{2}\.\d{4}):\s*(?P<message>.*)$", "15:04:05.000 02.01.2006", 85),
)
BLOCK_RULES = (
    BlockRule("keyvalue-dash-separated", r"^-{20,}$", r"^(?P<key>[A-Za-z][\w ]*?):[ \t]?(?P<value>.*)$", r"^-{20,}$", 70, ("Timestamp", "TimeStamp", "@timestamp"), ("2006-01-02T15:04:05.999999999Z07:00", "2006-01-02T15:04:05Z07:00")),
)
XML_RULES = (
    XmlRule("repeating-row-element", r"^\s*<", 80, ("@time", "@Timestamp", "@timestamp", "Timestamp", "TimeStamp", "TimeStamp_Absolute"), ("2006-01-02T15:04:05.999999999Z07:00", "2006-01-02 15:04:05Z07:00", "2006-01-02 15:04:05Z")),
)
ALL_RULES = (*LINE_RULES, *BLOCK_RULES, *XML_RULES)
FAMILIES = {"line": LineRule, "block": BlockRule, "xml": XmlRule}
LISTS = ("ts_field", "ts_layouts", "ts_candidates")


def load_rules(items: dict[str, dict]) -> tuple[list, dict[str, str]]:
    """(rules, problems by name) from mappings such as YAML gives, taken in the order of their names.

    An unknown family is reported and left out; a bad rule of a known family
    fails the whole set.
    """
    rules, problems = [], {}
    for origin in sorted(items):
        raw = dict(items[origin])
        family = raw.pop("family", None)
        if family not in FAMILIES:
            problems[origin] = f"unknown family {family!r}"
            continue
        kind = FAMILIES[family]
        unknown = set(raw) - {f.name for f in fields(kind)}
        if unknown:
            raise ValueError(f"{origin}: unknown keys {', '.join(sorted(unknown))}")
        for key in LISTS:
            if key in raw:
                raw[key] = (raw[key],) if isinstance(raw[key], str) else tuple(raw[key])
        if "ts_regex_subs" in raw:
            raw["ts_regex_subs"] = tuple((s["pattern"], s["replacement"]) for s in raw["ts_regex_subs"])
        try:
            rule = kind(**({"priority": DEFAULT_PRIORITY[family]} | raw))
            validate(rule)
        except (TypeError, re.error, ValueError) as e:
            raise ValueError(f"{origin}: {e}") from e
        rules.append(rule)
    return rules, problems


def validate(rule: LineRule | BlockRule | XmlRule) -> None:
    if not rule.name:
        raise ValueError("name is missing")
    if isinstance(rule, LineRule):
        re.compile(rule.parse)
        if "ts" not in rule.groups:
            raise ValueError("parse has no group ts")
        check_layout(rule.ts_layout)
        if rule.ts_use_mtime_date and rule.ts_use_mtime_year:
            raise ValueError("ts_use_mtime_date and ts_use_mtime_year exclude each other")
        try:
            ZoneInfo(rule.ts_assume_tz)
        except (ZoneInfoNotFoundError, ValueError) as e:
            raise ValueError(f"unknown time zone {rule.ts_assume_tz!r}") from e
        for pattern, _ in rule.ts_regex_subs:
            re.compile(pattern)
    if isinstance(rule, BlockRule):
        re.compile(rule.separator)
        if set(GROUP.findall(rule.field)) != {"key", "value"}:
            raise ValueError("field needs the groups key and value")
    if isinstance(rule, XmlRule) and not rule.sniff:
        raise ValueError("sniff is missing")
    for layout in getattr(rule, "ts_layouts", ()):
        check_layout(layout)


def check_layout(layout: str) -> None:
    """An example date such as 2006-01-02 15:04:05, not a pattern of another kind."""
    if not layout:
        raise ValueError("ts_layout is missing")
    if "%" in layout:
        raise ValueError(f"layout {layout!r} has percent signs; write the example date 2006-01-02 15:04:05 instead")
    if not any(piece in layout for piece, _ in LAYOUT_PIECES):
        raise ValueError(f"layout {layout!r} has no piece of the example date 2006-01-02 15:04:05")


def inventory(spark, rules=ALL_RULES):
    """(name, family, priority) of rules, to join with an audit."""
    family = {LineRule: "line", BlockRule: "block", XmlRule: "xml"}
    return spark.createDataFrame([(r.name, family[type(r)], r.priority) for r in rules], "name string, family string, priority int")
