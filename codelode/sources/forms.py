"""Form files: component trees as flat rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = (
    "path string, node_id int, parent_id int, depth int, ordinal int, name string, class string, "
    "props map<string,string>, prop_names array<string>, prop_lines map<string,int>, events map<string,string>, event_names array<string>, start_line int, end_line int"
)
# Properties shown in a form tree, in their order.
SHOWN = ["Caption", "Text", "Left", "Top", "Width", "Height", "ClientWidth", "ClientHeight", "Align", "TabOrder"]
_HEAD = re.compile(r"^\s*(?:object|inherited|inline)\s+([^\s:]+)\s*:\s*(\S+)\s*(?:\[\d+\])?\s*$", re.I)
_PROPERTY = re.compile(r"^\s*([A-Za-z_][\w.]*)\s*=\s*(.*)$")


def bare(line: str) -> str:
    """A line without its quoted strings."""
    return re.sub(r"'(?:[^']|'')*'", "", line)


def value_at(lines: list[str], at: int, first: str) -> tuple[str, int]:
    """The whole value of a property and the line after it: lists in parentheses, collections, binary data and continued strings."""
    value, at = first.strip(), at + 1
    if value == "(":
        parts = []
        while at < len(lines):
            line = lines[at].strip()
            at += 1
            last = line.endswith(")")
            part = line[:-1].strip() if last else line
            if part:
                parts.append(part)
            if last:
                break
        return f"({', '.join(parts)})", at
    if value == "<":
        parts, depth = [value], 1
        while at < len(lines) and depth > 0:
            line = lines[at].strip()
            parts.append(line)
            depth += bare(line).count("<") - bare(line).count(">")
            at += 1
        return " ".join(parts), at
    if value.startswith("{"):
        while not value.endswith("}") and at < len(lines):
            value = lines[at].strip()
            at += 1
        return "{...binary data...}", at
    while value.endswith("+") and at < len(lines):
        value = f"{value[:-1].strip()} {lines[at].strip()}"
        at += 1
    while at < len(lines) and lines[at].strip().startswith("'"):
        value += " + " + lines[at].strip()
        at += 1
    return value, at


def components(path: str, text: str) -> Iterator[dict]:
    """The components of one form in preorder; text outside a component is skipped."""
    lines = text.splitlines()
    stack: list[dict] = []
    done: list[dict] = []
    at = 0
    while at < len(lines):
        head = _HEAD.match(lines[at])
        if head:
            node = {
                "node_id": len(done), "parent_id": stack[-1]["node_id"] if stack else None, "depth": len(stack), "ordinal": len(done), "name": head[1], "class": head[2],
                "props": {}, "prop_names": [], "prop_lines": {}, "events": {}, "event_names": [], "start_line": at + 1, "end_line": None,
            }
            done.append(node)
            stack.append(node)
            at += 1
            continue
        if stack and lines[at].strip().lower() == "end":
            stack.pop()["end_line"] = at + 1
            at += 1
            continue
        m = _PROPERTY.match(lines[at]) if stack else None
        if m is None:
            at += 1
            continue
        name, line = m[1], at + 1
        value, at = value_at(lines, at, m[2])
        event = name.startswith("On") and "." not in name
        known = stack[-1]["events" if event else "props"]
        if name not in known:
            stack[-1]["event_names" if event else "prop_names"].append(name)
        known[name] = value
        if not event:
            stack[-1]["prop_lines"].setdefault(name, line)
    yield from done


def tree_lines(nodes: DataFrame) -> DataFrame:
    """(path, ordinal, lines): each component as indented lines: its head, the shown properties in fixed order, its events."""
    indent = F.repeat(F.lit("  "), F.col("depth"))
    shown = [F.when(F.coalesce(F.col("props")[p], F.lit("")) != "", F.concat(indent, F.lit(f"  {p} = "), F.col("props")[p])) for p in SHOWN]
    events = F.transform("event_names", lambda e: F.concat(indent, F.lit("  "), e, F.lit(" = "), F.element_at("events", e)))
    head = F.concat(indent, "name", F.lit(": "), "class")
    return nodes.select("path", "ordinal", F.concat(F.array(head), F.array_compact(F.array(*shown)), events).alias("lines")).orderBy("path", "ordinal")


def class_counts(nodes: DataFrame) -> DataFrame:
    """(path, class, n), classes case-sensitive."""
    return nodes.groupBy("path", "class").agg(F.count("*").alias("n"))


def event_lines(nodes: DataFrame) -> DataFrame:
    """(path, ordinal, pos, line) as ``Name.OnEvent = Handler``."""
    e = nodes.select("path", "ordinal", "name", "events", F.posexplode("event_names").alias("pos", "event"))
    return e.select("path", "ordinal", "pos", F.concat("name", F.lit("."), "event", F.lit(" = "), F.element_at("events", F.col("event"))).alias("line"))


def property_line(nodes: DataFrame, name: str, prop: str) -> DataFrame:
    """(path, line) of a property at the own depth of the first object of that name."""
    first = nodes.where(F.lower("name") == name.lower()).groupBy("path").agg(F.min_by("prop_lines", "ordinal").alias("p"))
    return first.select("path", F.try_element_at(F.map_values(F.map_filter("p", lambda k, v: F.lower(k) == prop.lower())), F.lit(1)).alias("line")).where("line is not null")


def standalone_action_button(nodes: DataFrame, button_class: str = "TBitBtn") -> DataFrame:
    """(path, button, action): buttons whose action's parent isn't an action list, if a form has exactly one."""
    b = nodes.where(F.lower("class") == button_class.lower()).select("path", F.col("name").alias("button"), F.col("props")["Action"].alias("action"))
    a = nodes.select("path", F.col("name").alias("action"), "parent_id")
    p = nodes.select("path", F.col("node_id").alias("parent_id"), F.col("class").alias("parent_class"))
    hits = b.join(a, ["path", "action"]).join(p, ["path", "parent_id"]).where(~F.lower("parent_class").contains("actionlist"))
    only = hits.groupBy("path").agg(F.count("*").alias("n"), F.min(F.struct("button", "action")).alias("x")).where("n = 1")
    return only.select("path", "x.button", "x.action")


def is_event(name: Column) -> Column:
    """Event properties start with On and have no dot."""
    return name.startswith("On") & ~F.contains(name, F.lit("."))
