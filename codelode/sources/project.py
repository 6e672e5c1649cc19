"""Project files: property groups in document order, conditions, macros, imports, option sets."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import ship

PROPERTY = "project string, seq int, name string, value string, source string"


class ProjectError(ValueError):
    """A project that can't be evaluated: a bad condition, a circular import, broken XML."""


def expand(value: str, props: dict[str, str], env: dict[str, str], unknown_empty: bool = False, open_: tuple[str, ...] = ()) -> str:
    """``$(Name)`` from properties, then the environment; names inside themselves and unknown ones are empty or stay as written."""

    def one(m: re.Match) -> str:
        name = m[1]
        key = name.lower()
        found = next((t[k] for t in (props, env) for k in t if k.lower() == key), None)
        if key in open_ or found is None:
            return "" if unknown_empty else m[0]
        return expand(found, props, env, unknown_empty, (*open_, key))

    return re.sub(r"\$\(([^)]*)\)", one, value)


_LEX = re.compile(r"\s*(?:('[^']*')|(==|!=|\(|\))|([^\s()'=!]+)|(!))")


class Condition:
    """A recursive-descent reader of conditions: or over and over not, comparisons, Exists() and HasTrailingSlash()."""

    def __init__(self, text: str, exists: Callable[[str], bool]):
        self.parts, at, self.exists = [], 0, exists
        text = text.strip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m or m[0].strip() == "":
                raise ProjectError(f"unexpected text in condition: {text[at:]}")
            # the argument of a function runs to its closing parenthesis, quoted or not
            call = re.match(r"\s*(Exists|HasTrailingSlash)\s*\(\s*('[^']*'|[^()']*)\s*\)", text[at:], re.I)
            if call:
                self.parts.append(("call", call[1].lower(), call[2].strip().strip("'")))
                at += call.end()
                continue
            self.parts.append(("text", m[1][1:-1]) if m[1] is not None else ("mark", m[2] or m[4]) if (m[2] or m[4]) else ("word", m[3]))
            at = m.end()
        self.i = 0

    def value(self) -> bool:
        if not self.parts:
            return True
        out = self._or()
        if self.i < len(self.parts):
            raise ProjectError(f"unexpected {self.parts[self.i][1]!r} in condition")
        return out

    def _peek(self, *words: str) -> bool:
        return self.i < len(self.parts) and self.parts[self.i][0] in ("word", "mark") and self.parts[self.i][1].lower() in words

    def _or(self) -> bool:
        out = self._and()
        while self._peek("or"):
            self.i += 1
            right = self._and()
            out = out or right
        return out

    def _and(self) -> bool:
        out = self._not()
        while self._peek("and"):
            self.i += 1
            right = self._not()
            out = out and right
        return out

    def _not(self) -> bool:
        if self._peek("!", "not"):
            self.i += 1
            return not self._not()
        if self._peek("("):
            self.i += 1
            out = self._or()
            if not self._peek(")"):
                raise ProjectError("missing ) in condition")
            self.i += 1
            return out
        if self.i < len(self.parts) and self.parts[self.i][0] == "call":
            _, name, argument = self.parts[self.i]
            self.i += 1
            return self.exists(argument) if name == "exists" else argument.endswith(("\\", "/"))
        left = self._operand()
        if self._peek("==", "!="):
            same = self.parts[self.i][1] == "=="
            self.i += 1
            return (left.lower() == self._operand().lower()) == same
        if left.lower() in ("true", "false"):
            return left.lower() == "true"
        raise ProjectError("a comparison is missing in condition")

    def _operand(self) -> str:
        if self.i >= len(self.parts) or self.parts[self.i][0] not in ("text", "word"):
            raise ProjectError("a value is missing in condition")
        self.i += 1
        return self.parts[self.i - 1][1]


def holds(condition: str, props: dict[str, str], env: dict[str, str], exists: Callable[[str], bool] = lambda _: False) -> bool:
    """Whether a condition holds; macros that nothing defines are empty."""
    if condition.count("'") % 2:
        raise ProjectError("unterminated text in condition")
    return Condition(expand(condition, props, env, unknown_empty=True), exists).value()


def _tag(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def evaluate(path: str, read: Callable[[str], str | None], env: dict[str, str], props: dict[str, str] | None = None, open_: tuple[str, ...] = ()) -> Iterator[tuple[str, str, str]]:
    """(name, value, source file) of each property set, in order; ``props`` holds the state. Later values see earlier ones, themselves included."""
    props = {} if props is None else props
    here = path.replace("\\", "/")
    if here.lower() in open_:
        raise ProjectError(f"circular import of {path}")
    text = read(here)
    if text is None:
        raise ProjectError(f"no file {path}")
    folder = posixpath.dirname(here)

    def resolve(value: str) -> str:
        value = value.replace("\\", "/")
        return posixpath.normpath(value if re.match(r"/|[A-Za-z]:|\w+://", value) else posixpath.join(folder, value))

    def exists(value: str) -> bool:
        return bool(value) and read(resolve(value)) is not None

    def test(node: ET.Element) -> bool:
        return holds(node.get("Condition", ""), props, env, exists)

    def imports(node: ET.Element) -> Iterator[tuple[str, str, str]]:
        target = expand(node.get("Project", ""), props, env)
        if test(node) and "$(" not in target and read(resolve(target)) is not None:
            yield from evaluate(resolve(target), read, env, props, (*open_, here.lower()))

    for node in ET.fromstring(text.lstrip("﻿")):
        kind = _tag(node)
        if kind == "PropertyGroup" and test(node):
            for item in node:
                if test(item):
                    name = _tag(item)
                    own = next((k for k in props if k.lower() == name.lower()), name)
                    # a property that names itself takes its value so far
                    raw = re.sub(rf"(?i)\$\({re.escape(name)}\)", lambda _: props.get(own, ""), item.text or "")
                    value = expand(raw, props, env)
                    props[own] = value
                    yield own, value, here
        elif kind == "Import":
            yield from imports(node)
        elif kind == "ImportGroup" and test(node):
            for item in node:
                if _tag(item) == "Import":
                    yield from imports(item)


def properties(projects: DataFrame, env: dict[str, str], option_set: str = "CfgDependentOn") -> DataFrame:
    """(project, seq, name, value, source) of projects (project, files map<path, text>): the option set's properties first, then the project's own.

    Projects are rows; each is interpreted in one task, with its files at hand.
    """
    ship(projects.sparkSession)

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for project, files in zip(frame["project"], frame["files"], strict=True):
                table = {k.replace("\\", "/"): v for k, v in (dict(files) if files is not None else {}).items()}
                base = dict(env)
                first = {n: v for n, v, _ in evaluate(project, table.get, base)}
                out, props = [], {}
                depends = first.get(option_set, "")
                target = posixpath.normpath(posixpath.join(posixpath.dirname(project.replace("\\", "/")), depends.replace("\\", "/"))) if depends else ""
                if target and target in table:
                    out += list(evaluate(target, table.get, base, props))
                out += list(evaluate(project, table.get, base, props))
                rows += [(project, i, n, v, s) for i, (n, v, s) in enumerate(out)]
            yield pd.DataFrame(rows, columns=["project", "seq", "name", "value", "source"])

    return projects.select("project", "files").mapInPandas(run, PROPERTY)


def main_source(text: str) -> str:
    """The first filled MainSource of any property group, whatever its condition."""
    for node in ET.fromstring(text.lstrip("﻿")).iter():
        if _tag(node) == "MainSource" and (node.text or "").strip():
            return node.text.strip()
    return ""


def reference_folders(lines: DataFrame) -> DataFrame:
    """(path, folder) of the distinct folders of reference items in project text (path, text)."""
    found = F.regexp_extract_all("text", F.lit(r'DCCReference\s+Include="([^"]+)"'), F.lit(1))
    rows = lines.select("path", F.explode(found).alias("ref"))
    return rows.select("path", F.regexp_extract(F.translate("ref", "/", "\\"), r"^(.*)\\[^\\]*$", 1).alias("folder")).distinct()


def form_modules(projects: DataFrame) -> DataFrame:
    """(path, unit, file): ``Unit in 'file.pas'`` of the main source; only projects without any fall back to reference items. ``projects`` has (path, main_text, project_text)."""
    named = F.regexp_extract_all("main_text", F.lit(r"(?i)([\w.]+)\s+in\s+'([^']+\.pas)'"), F.lit(0))
    units = projects.select("path", F.explode(named).alias("m")).select("path", F.regexp_extract("m", r"^([\w.]+)", 1).alias("unit"), F.regexp_extract("m", r"'([^']+)'", 1).alias("file"))
    refs = projects.join(units.select("path").distinct(), "path", "left_anti")
    refs = refs.select("path", F.explode(F.regexp_extract_all("project_text", F.lit(r'(?i)DCCReference\s+Include="([^"]+\.pas)"'), F.lit(1))).alias("file"))
    return units.union(refs.select("path", F.regexp_extract("file", r"([^\\/]+)\.pas$", 1).alias("unit"), "file"))


def resolved_lists(props: DataFrame, keys: list[str]) -> DataFrame:
    """(project, name, items) of list properties: last value, split at semicolons, first spelling of each item."""
    from codelode.functions.text import ordered_distinct, parse_list

    last = props.where(F.col("name").isin(keys)).groupBy("project", "name").agg(F.max_by("value", "seq").alias("value"))
    return last.select("project", "name", ordered_distinct(parse_list(F.col("value"), ";")).alias("items"))
