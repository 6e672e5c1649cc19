"""Analyzer reports: findings, call trees, complexity, totals and status from XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import complexity_name, is_aggregate_name

FINDING = "path string, seq int, severity string, report string, section string, module string, line int, message string, id string, kind string"
ENTRY = "path string, seq int, raw string, dp int, loc int"
SECTION = "path string, seq int, report string, section string, count string"
#: Report file -> severity, in the order in which their findings are listed.
SEVERITIES = {"Strong Warnings.xml": "strong-warning", "Warnings.xml": "warning", "Optimization.xml": "optimization", "Exception.xml": "exception"}


def _line(text: str | None) -> str:
    return (text or "").replace("\r", " ").replace("\n", " ").replace("|", "/").strip()


def _child(node: ET.Element, name: str) -> str:
    return next((_line(x.text) for x in node if x.tag.lower() == name), "")


def _place(node: ET.Element, name: str = "locmod") -> tuple[str, int]:
    """Module and line of a node: its own line number wins over the one in parentheses."""
    text = _child(node, name)
    own = _child(node, "locline")
    line = int(own) if re.fullmatch(r"[+-]?\d+", own) else 0
    m = re.fullmatch(r"(.*)\(\s*([+-]?\d+)\s*\)", text)
    if m and m[1].strip():
        return m[1].strip(), line or int(m[2])
    return text, line


def _row(severity: str, report: str, section: str, place: tuple[str, int], message: str, id_: str = "", kind: str = "") -> dict:
    return {"severity": severity, "report": report, "section": section, "module": place[0], "line": place[1], "message": message or "-", "id": id_ or None, "kind": kind or None}


def _section(node: ET.Element, severity: str, report: str) -> Iterator[dict]:
    section, name = _line(node.get("name")), ""
    for x in node:
        tag = x.tag.lower()
        if tag == "name":
            name = _line(x.text)
        elif tag == "loc":
            kind = _child(x, "kind")
            yield _row(severity, report, section, _place(x), name or kind, "", kind)
        elif tag == "item":
            id_, kind = _child(x, "id"), _child(x, "kind")
            spots = [y for y in x if y.tag.lower() == "loc"]
            for y in spots:
                own = _child(y, "kind")
                yield _row(severity, report, section, _place(y), id_ or name or kind or own, id_, kind or own)
            if not spots and _child(x, "locmod"):
                module, line = _place(x)
                inner = re.search(r"\(\s*([+-]?\d+)\s*\)$", _child(x, "locmod"))
                yield _row(severity, report, section, (module, int(inner[1]) if inner else 0), id_ or name or kind, id_, kind)


def _calls(node: ET.Element, severity: str, report: str, section: str) -> Iterator[dict]:
    """One row per nested caller, at any depth."""
    if node.tag.lower() == "called_by":
        yield _row(severity, report, section, _place(node), _child(node, "name"))
    for x in node:
        if x.tag.lower() in ("called_by", "branch", "section"):
            yield from _calls(x, severity, report, section)


def _name(path: str) -> str:
    return re.sub(r"%20", " ", path.replace("\\", "/").rsplit("/", 1)[-1])


def findings(path: str, text: str) -> Iterator[dict]:
    """Findings of one report in file order; other files have none."""
    report = _name(path)
    severity = SEVERITIES.get(report)
    if severity is None:
        return
    walk = _calls if severity == "exception" else None
    seq = 0
    for node in ET.fromstring(text):
        if node.tag.lower() != "section":
            continue
        for row in walk(node, severity, report, _line(node.get("name"))) if walk else _section(node, severity, report):
            if row["module"]:
                seq += 1
                yield row | {"seq": seq}


def complexity(path: str, text: str) -> Iterator[dict]:
    """Raw complexity entries of the section per module and subprogram."""
    number = lambda x: int(x) if re.fullmatch(r"[+-]?\d+", x) else 0
    for section in ET.fromstring(text):
        if section.tag.lower() == "section" and (section.get("name") or "").lower() == "complexity per module/subprogram":
            for i, x in enumerate(y for y in section if y.tag.lower() == "module_or_subprogram"):
                if _child(x, "name"):
                    yield {"seq": i, "raw": _child(x, "name"), "dp": number(_child(x, "dp")), "loc": number(_child(x, "lines_of_code"))}
            return


def complexity_entries(raw: DataFrame) -> DataFrame:
    """(path, seq, name, is_routine, is_aggregate, dp, loc)."""
    split = complexity_name(F.col("raw"))
    return raw.select("path", "seq", split["name"].alias("name"), split["is_routine"].alias("is_routine"), is_aggregate_name(F.col("raw")).alias("is_aggregate"), "dp", "loc")


def module_totals(path: str, text: str) -> Iterator[dict]:
    """(module, lines): of the first section, each module's first item of kind lines, if over 0."""
    section = next((x for x in ET.fromstring(text) if x.tag.lower() == "section"), None)
    for i, module in enumerate(x for x in (section if section is not None else ()) if x.tag.lower() == "module"):
        item = next((y for y in module if y.tag.lower() == "item" and _child(y, "kind").lower() == "lines"), None)
        total = _child(item, "total") if item is not None else ""
        if _child(module, "name") and re.fullmatch(r"\d+", total) and int(total) > 0:
            yield {"seq": i, "module": _child(module, "name"), "lines": int(total)}


def module_lines(rows: DataFrame) -> DataFrame:
    """(module, lines) by module in any case; the last one counts."""
    return rows.groupBy(F.lower("module").alias("k")).agg(F.max_by("module", "seq").alias("module"), F.max_by("lines", "seq").alias("lines")).drop("k")


def sections(path: str, text: str) -> Iterator[dict]:
    """Every section with a count, at any depth."""
    for i, node in enumerate(ET.fromstring(text).iter()):
        if node.tag.lower() == "section" and node.get("count") is not None:
            yield {"seq": i, "report": _name(path), "section": node.get("name", ""), "count": node.get("count")}


def status(path: str, text: str) -> Iterator[dict]:
    """(name, value) of the leaves of a status report."""
    for node in ET.fromstring(text).iter():
        if len(node) == 0 and (node.text or "").strip():
            yield {"name": node.tag, "value": node.text.strip()}
