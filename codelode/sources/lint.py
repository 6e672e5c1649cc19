"""Lint reports: text, CSV and XML, parsed to findings and filtered to reports."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.text import PASCAL_KEYWORDS, matches_any_mask, rule_id  # noqa: F401

FINDING = "path string, code string, file string, line int, col int, message string"


def text_findings(lines: DataFrame) -> DataFrame:
    """(path, code, file, line, col, message) of lint lines ``code text (line, col)`` under ``File:`` headers."""
    head = F.regexp_extract("text", r"(?i)^File:\s*(.*?)\s*$", 1)
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("file", F.last(F.when(F.lower("text").startswith("file:"), head), ignorenulls=True).over(w))
    pattern = r"^\s*([A-Z][0-9]{3})\s+(.*?)\s*\((\d+),\s*(\d+)\)\s*$"
    part = lambda i: F.regexp_extract("text", pattern, i)
    out = rows.where(F.col("file").isNotNull() & F.col("text").rlike(pattern))
    return out.select("path", part(1).alias("code"), "file", part(3).cast("int").alias("line"), part(4).cast("int").alias("col"), part(2).alias("message"))


def filter_text(lines: DataFrame, masks: list[str], ignored: list[str]) -> DataFrame:
    """Report lines (path, line_no, text) without masked files, ignored rules and headers left empty.

    Lines before the first header stay. A group is a header and the lines up to the next.
    """
    header = F.lower("text").startswith("file:")
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("g", F.sum(header.cast("int")).over(w)).withColumn("is_header", header)
    file = F.trim(F.substr("text", F.lit(6)))
    rows = rows.withColumn("masked", F.max(F.when(F.col("is_header"), matches_any_mask(file, masks))).over(Window.partitionBy("path", "g")))
    token = F.regexp_extract("text", r"^\s*(\S*)", 1)
    dropped = F.coalesce(rule_id(token).isin(ignored), F.lit(False)) if ignored else F.lit(False)
    kept = rows.where("g = 0 or not masked").where((F.col("g") == 0) | F.col("is_header") | ~dropped)
    body = F.sum((~F.col("is_header")).cast("int")).over(Window.partitionBy("path", "g"))
    return kept.withColumn("body", body).where("g = 0 or body > 0").select("path", "line_no", "text").orderBy("path", "line_no")


def delimiter(line: Column) -> Column:
    """Comma or semicolon, whichever a CSV line has more of outside quotes; a tie is a comma, neither is null."""
    bare = F.regexp_replace(line, '"[^"]*("|$)', "")
    commas, semis = (F.length(bare) - F.length(F.translate(bare, c, "")) for c in ",;")
    return F.when((commas > 0) | (semis > 0), F.when(semis > commas, ";").otherwise(","))


def csv_fields(line: Column, sep: str) -> Column:
    """The fields of one CSV line; quotes double inside quotes and a line is a whole row."""
    found = F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(rf'("(?:[^"]|"")*"[^{sep}]*|[^{sep}]*){sep}'), F.lit(1))
    return F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, r'^"((?:[^"]|"")*)"(.*)$', "$1$2"), F.lit('""'), F.lit('"'))).otherwise(x))


_PATH = re.compile(r"(?is):\\|\\.*\.(?:pas|dpr|dpk)$")
_RULE = re.compile(r"(?i)^\s*[WCO][0-9]+\s*$")
RULE_NAMES = ("rule", "ruleid", "rule id", "code", "id")
FILE_NAMES = ("file", "filename", "file name", "path")


def split_csv(line: str, sep: str) -> list[str]:
    out, at = [], 0
    for m in re.finditer(rf'("(?:[^"]|"")*"[^{sep}]*|[^{sep}]*)(?:{sep}|$)', line):
        if m.start() < at:
            break
        raw = m[1]
        out.append(re.sub(r'^"((?:[^"]|"")*)"(.*)$', r"\1\2", raw, flags=re.S).replace('""', '"') if raw.startswith('"') else raw)
        at = m.end()
        if not m[0].endswith(sep):
            break
    return out


class Layout:
    """Where a CSV report has its rule and file, judged from its first two lines."""

    def __init__(self, sep: str, header: bool, rule: int, file: int):
        self.sep, self.header, self.rule, self.file = sep, header, rule, file


def _number(text: str) -> bool:
    return bool(re.fullmatch(r"\s*[+-]?\d+\s*", text))


def _layout(first: list[str], second: list[str] | None, sep: str) -> Layout | None:
    located = len(first) >= 5 and _PATH.search(first[0].strip().replace("/", "\\")) and _number(first[1]) and _number(first[2]) and _RULE.match(first[3])
    names = [x.strip().lower() for x in first]
    header = not located and any(x in ("file", "filename", "rule", "ruleid", "line") for x in names)
    rule = next((i for i, x in enumerate(names) if x in RULE_NAMES), -1) if header else -1
    file = next((i for i, x in enumerate(names) if x in FILE_NAMES), -1) if header else -1
    sample = second if header else first
    if sample is None:
        return None
    if rule < 0 or file < 0:
        rule = rule if rule >= 0 else next((i for i, x in enumerate(sample) if _RULE.match(x)), -1)
        file = file if file >= 0 else next((i for i, x in enumerate(sample) if _PATH.search(x.replace("/", "\\"))), -1)
    if not (0 <= rule < len(sample) and 0 <= file < len(sample)) or not _RULE.match(sample[rule]) or not _PATH.search(sample[file].replace("/", "\\")):
        return None
    if not header:
        if len(sample) < 5 or not (_number(sample[1]) and _number(sample[2])):
            return None
        inner = split_csv(sample[file], ";" if sep == "," else ",")
        if len(inner) >= 4 and _number(inner[1]) and _number(inner[2]) and _RULE.match(inner[3]):
            return None
    return Layout(sep, header, rule, file)


def csv_layout(head: list[str]) -> Layout | None:
    """The layout of a report from its first lines; the voted delimiter first, then the other."""
    if not head:
        return None
    bare = re.sub(r'"[^"]*("|$)', "", head[0])
    voted = ";" if bare.count(";") > bare.count(",") else ","
    for sep in (voted, "," if voted == ";" else ";"):
        second = split_csv(head[1], sep) if len(head) > 1 else None
        found = _layout(split_csv(head[0], sep), second, sep)
        if found:
            return found
    return None


def filter_csv(lines: DataFrame, masks: list[str], ignored: list[str], head: list[str]) -> DataFrame:
    """Raw rows of a CSV report without masked files and ignored rules; empty lines go, the header stays. ``head`` is its first two lines."""
    layout = csv_layout(head)
    rows = lines.where(F.trim("text") != "")
    if layout is None:
        return rows
    fields = csv_fields(F.col("text"), layout.sep)
    rule, file = rule_id(F.coalesce(F.get(fields, F.lit(layout.rule)), F.lit(""))), F.coalesce(F.get(fields, F.lit(layout.file)), F.lit(""))
    gone = matches_any_mask(F.trim(file), masks) | (F.coalesce(rule.isin(ignored), F.lit(False)) if ignored else F.lit(False))
    is_header = (F.col("line_no") == 1) if layout.header else F.lit(False)
    return rows.where(is_header | ~gone)


def csv_findings(lines: DataFrame, sep: str = ",") -> DataFrame:
    """(path, code, file, line, col, message) of headerless rows file, line, column, rule, message."""
    f = csv_fields(F.col("text"), sep)
    at = lambda i: F.get(f, F.lit(i))
    out = lines.where(F.trim("text") != "").select(
        "path", rule_id(at(3)).alias("code"), at(0).alias("file"), at(1).try_cast("int").alias("line"), at(2).try_cast("int").alias("col"), at(4).alias("message")
    )
    return out.where("code is not null and line is not null")


def xml_messages(path: str, text: str) -> Iterator[dict]:
    """Rows (file, ordinal, id, raw) of a lint XML report."""
    for file in ET.fromstring(text).iter("file"):
        for i, message in enumerate(file):
            yield {"file": file.get("name", ""), "ordinal": i, "id": message.get("id", ""), "raw": ET.tostring(message, encoding="unicode").strip()}


XML_MESSAGE = "path string, file string, ordinal int, id string, raw string"


def filter_xml(messages: DataFrame, masks: list[str], ignored: list[str]) -> DataFrame:
    """(path, file, messages): messages left after masks and ignored rules; files without any go."""
    kept = messages.where(~matches_any_mask(F.col("file"), masks))
    if ignored:
        kept = kept.where(~F.coalesce(rule_id(F.col("id")).isin(ignored), F.lit(False)))
    return kept.groupBy("path", "file").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "raw"))).alias("messages"))
