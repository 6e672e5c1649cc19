"""Pascal sources as relations: units, uses edges, global symbols, routines, locals and identifier usages."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.sources.files import parse_files

#: One tagged row per fact, so a file is tokenized once. ``kind`` says which other fields count.
FACT = (
    "path string, seq int, kind string, unit string, name string, type string, section string, routine string, routine_id int, line int, col int, end_line int, access string, target string"
)
# Reserved words that end or open declarations, and the standard names that are no symbols.
RESERVED = frozenset(
    "and array as asm begin case class const constructor destructor dispinterface div do downto else end except exports file finalization finally for function goto if implementation in inherited "
    "initialization inline interface is label library mod nil not object of on or out packed procedure program property raise record repeat resourcestring set shl shr string then threadvar to try type unit "
    "until uses var while with xor package contains requires operator".split()
)
_TOKEN = re.compile(r"\{.*?\}|\(\*.*?\*\)|//[^\n]*|'(?:[^'\n]|'')*'|[A-Za-z_][A-Za-z0-9_]*|\$[0-9A-Fa-f]+|\d+(?:\.\d+)?|:=|\.\.|<=|>=|<>|\S", re.S)

Token = tuple[str, int, int]  # text, line, column


def tokenize(text: str) -> list[Token]:
    """Words, literals and marks with their 1-based places; comments and directives go."""
    out, line, start, at = [], 1, 0, 0
    for m in _TOKEN.finditer(text):
        gap = text.count("\n", at, m.start())
        if gap:
            line += gap
            start = text.rfind("\n", at, m.start()) + 1
        word = m[0]
        if not (word.startswith("//") or word.startswith("{") or word.startswith("(*")):
            out.append((word, line, m.start() - start + 1))
        inner = word.count("\n")
        if inner:
            line += inner
            start = m.start() + word.rfind("\n") + 1
        at = m.end()
    return out


class Reader:
    """Walks the tokens of one file and collects facts."""

    def __init__(self, text: str):
        self.tokens = tokenize(text)
        self.at = 0
        self.facts: list[dict] = []
        self.unit = ""
        self.section = "interface"
        self.routines = 0

    def low(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][0].lower() if i < len(self.tokens) else ""

    def take(self) -> Token:
        token = self.tokens[self.at]
        self.at += 1
        return token

    def more(self) -> bool:
        return self.at < len(self.tokens)

    def dotted(self) -> Token:
        """A name with its dots."""
        text, line, col = self.take()
        while self.low() == "." and self.at + 1 < len(self.tokens) and re.match(r"[A-Za-z_]", self.tokens[self.at + 1][0]):
            self.take()
            text += "." + self.take()[0]
        return text, line, col

    def skip_to(self, *ends: str) -> list[Token]:
        """Tokens up to one of the marks outside brackets; the mark is taken."""
        depth, out = 0, []
        while self.more():
            word = self.low()
            if depth == 0 and word in ends:
                self.take()
                break
            depth += (word in "([") - (word in ")]") if len(word) == 1 else 0
            out.append(self.take())
        return out

    def add(self, kind: str, **fields) -> None:
        self.facts.append({"seq": len(self.facts), "kind": kind, "unit": self.unit, "section": self.section, **fields})

    def read(self) -> list[dict]:
        while self.more():
            word = self.low()
            if word in ("unit", "program", "library", "package") and not self.unit:
                self.take()
                name, line, col = self.dotted()
                self.unit = name
                self.section = "interface" if word == "unit" else "program"
                self.add("unit", name=name, type=word, line=line, col=col)
                self.skip_to(";")
            elif word in ("interface", "implementation"):
                self.section = word
                self.take()
            elif word in ("initialization", "finalization"):
                self.take()
                self.body("", word)
            elif word in ("uses", "contains", "requires"):
                self.uses(word)
            elif word in ("var", "threadvar"):
                self.take()
                self.variables(word)
            elif word in ("const", "resourcestring"):
                self.take()
                self.constants()
            elif word == "type":
                self.take()
                self.types()
            elif word in ("procedure", "function", "constructor", "destructor", "operator") or (word == "class" and self.low(1) in ("procedure", "function", "constructor", "destructor", "operator")):
                self.routine()
            elif word == "begin":
                self.take()
                self.body("", "program")
            else:
                self.take()
        return self.facts

    def uses(self, word: str) -> None:
        self.take()
        kind = "contains" if word == "contains" else "project" if self.section == "program" else self.section
        while self.more():
            name, line, col = self.dotted()
            file = None
            if self.low() == "in":
                self.take()
                file = self.take()[0].strip("'")
            if re.match(r"[A-Za-z_]", name):
                self.add("uses", name=name, type=kind, line=line, col=col, target=file)
            if self.more() and self.take()[0] == ";":
                break

    def names(self) -> list[Token]:
        out = []
        while self.more() and re.match(r"[A-Za-z_&]", self.tokens[self.at][0]):
            out.append(self.take())
            if self.low() != ",":
                break
            self.take()
        return out

    def starts_name(self) -> bool:
        return self.more() and bool(re.match(r"[A-Za-z_&]", self.low())) and self.low() not in RESERVED

    def variables(self, word: str, kind: str | None = None) -> None:
        while self.starts_name():
            names = self.names()
            if self.low() != ":":
                return
            self.take()
            type_ = " ".join(t[0] for t in self.skip_to(";") if t[0] not in ("=",))
            for name, line, col in names:
                self.add("symbol", name=name, type=type_, section=kind or word, line=line, col=col)

    def constants(self) -> None:
        while self.starts_name():
            name, line, col = self.take()
            typed = self.low() == ":"
            rest = self.skip_to(";")
            if typed:
                type_ = " ".join(t[0] for t in rest[1:]).split(" = ")[0]
                self.add("symbol", name=name, type=type_, section="typedconst", line=line, col=col)

    def types(self) -> None:
        """Type declarations; of classes and records only class variables are kept."""
        while self.starts_name():
            self.take()
            if self.low() == "<":
                self.skip_to(">")
            if self.low() != "=":
                return
            self.take()
            if self.low() == "packed":
                self.take()
            if self.low() in ("class", "record", "object", "interface", "dispinterface") and self.low(1) not in (";", "of"):
                self.take()
                if self.low() == "(":
                    self.take()
                    self.skip_to(")")
                if self.low() == ";":
                    self.take()
                    continue
                self.members()
                self.skip_to(";")
            else:
                self.skip_to(";")

    def members(self) -> None:
        while self.more() and self.low() != "end":
            if self.low() == "class" and self.low(1) in ("var", "threadvar"):
                self.take()
                self.take()
                self.variables("var", "classvar")
            elif self.low() in ("procedure", "function", "constructor", "destructor", "property", "operator", "class"):
                self.skip_to(";")
            elif self.low() == "record":
                self.take()
                self.members()
                self.take()
            else:
                self.take()
        if self.more():
            self.take()

    def routine(self) -> None:
        if self.low() == "class":
            self.take()
        self.take()
        name, line, col = self.dotted()
        params: list[Token] = []
        if self.low() == "(":
            self.take()
            params = self.skip_to(")")
        self.skip_to(";")
        while self.low() in ("overload", "virtual", "override", "stdcall", "cdecl", "inline", "static", "reintroduce", "abstract", "dynamic", "register", "safecall", "message", "platform", "deprecated"):
            self.skip_to(";")
        if self.section == "interface" or self.low() in ("forward", "external"):
            if self.low() in ("forward", "external"):
                self.skip_to(";")
            return
        self.routines += 1
        id_ = self.routines
        fact = len(self.facts)
        self.add("routine", name=name, routine=name, routine_id=id_, line=line, col=col)
        expects = True
        for i, (word, pl, pc) in enumerate(params):
            nxt = params[i + 1][0] if i + 1 < len(params) else ""
            if expects and re.match(r"[A-Za-z_]", word) and word.lower() not in RESERVED and nxt in (",", ":", ";", ""):
                self.add("local", name=word, routine=name, routine_id=id_, line=pl, col=pc)
            expects = word in (",", ";") or (expects and word.lower() in ("const", "var", "out")) or (expects and nxt in (",", ":"))
            if word == ":":
                expects = False
        self.add("local", name="Result", routine=name, routine_id=id_, line=line, col=col)
        while self.more():
            word = self.low()
            if word in ("var", "const", "threadvar"):
                self.take()
                while self.starts_name():
                    for n, nl, nc in self.names():
                        self.add("local", name=n, routine=name, routine_id=id_, line=nl, col=nc)
                    self.skip_to(";")
            elif word in ("procedure", "function"):
                self.routine()
            elif word in ("type", "label"):
                self.take()
                self.types() if word == "type" else self.skip_to(";")
            elif word in ("begin", "asm"):
                self.take()
                end = self.body(name, "routine", id_)
                self.facts[fact]["end_line"] = end
                return
            else:
                return

    def body(self, routine: str, where: str, id_: int | None = None) -> int:
        """Identifier usages up to the matching end. A name is written if it, or what it begins, is left of the statement's assignment."""
        depth, statement = 1, []
        line = 0
        while self.more():
            word, line, col = self.take()
            low = word.lower()
            if low in ("begin", "case", "try", "asm"):
                depth += 1
            elif low == "end":
                depth -= 1
            if low in (";", "begin", "then", "else", "do", "of", "try", "finally", "except", "repeat", "end", "until"):
                self.flush(statement, routine, id_)
                statement = []
                if depth == 0:
                    if self.low() in (";", "."):
                        self.take()
                    break
                if where != "routine" and low == "end" and self.low() == ".":
                    break
            else:
                statement.append((word, line, col))
        self.flush(statement, routine, id_)
        return line

    def flush(self, statement: list[Token], routine: str, id_: int | None) -> None:
        assign = next((i for i, t in enumerate(statement) if t[0] == ":="), -1)
        for i, (word, line, col) in enumerate(statement):
            if not re.match(r"[A-Za-z_]", word) or word.lower() in RESERVED:
                continue
            if i and statement[i - 1][0] == ".":
                qualifier = statement[i - 2][0] if i >= 2 else ""
                self.add("usage", name=word, routine=routine, routine_id=id_, line=line, col=col, access="write" if i < assign else "read", target=qualifier)
            else:
                self.add("usage", name=word, routine=routine, routine_id=id_, line=line, col=col, access="write" if i < assign else "read")


def facts(path: str, text: str) -> Iterator[dict]:
    yield from Reader(text).read()


def read(files: DataFrame) -> DataFrame:
    """All facts of the source files (path, content, ...)."""
    return parse_files(files.dropDuplicates(["path"]), facts, FACT)


def uses_edges(all_facts: DataFrame) -> DataFrame:
    """(src, dst, edge_kind, seq)."""
    return all_facts.where("kind = 'uses'").select(F.col("unit").alias("src"), F.col("name").alias("dst"), F.col("type").alias("edge_kind"), F.xxhash64("path", "seq").alias("seq"))


def dependency_nodes(all_facts: DataFrame, root: str = "") -> DataFrame:
    """(name, path, is_project_unit, resolution_rank, seq): units read, and used names that no file gave."""
    units = all_facts.where("kind = 'unit'").select("name", "path", F.contains(F.lower("path"), F.lit(root.lower())).alias("is_project_unit"), F.lit(0).alias("resolution_rank"), F.lit(0).cast("long").alias("seq"))
    used = all_facts.where("kind = 'uses'").select("name").distinct()
    known = units.select(F.lower("name").alias("k")).distinct()
    missing = used.join(known, F.lower("name") == F.col("k"), "left_anti").select("name", F.lit(None).cast("string").alias("path"), F.lit(False).alias("is_project_unit"), F.lit(1).alias("resolution_rank"), F.lit(1).cast("long").alias("seq"))
    return units.union(missing)


def symbols(all_facts: DataFrame) -> DataFrame:
    """(symbol_id, unit, file, name, type, kind, line, col) of global symbols."""
    s = all_facts.where("kind = 'symbol'")
    return s.select(F.xxhash64("path", "line", "col").alias("symbol_id"), "unit", F.col("path").alias("file"), "name", "type", F.col("section").alias("kind"), "line", "col")


def usages(all_facts: DataFrame) -> DataFrame:
    """(usage_id, routine_id, unit, routine, file, name, line, col, access); routine ids are unique over files."""
    u = all_facts.where("kind = 'usage'")
    return u.select(
        F.xxhash64("path", "line", "col").alias("usage_id"), F.concat_ws("#", "path", F.col("routine_id").cast("string")).alias("routine_id"), "unit", "routine", F.col("path").alias("file"), "name", "line", "col", "access"
    )


def routine_locals(all_facts: DataFrame) -> DataFrame:
    """(routine_id, name)."""
    return all_facts.where("kind = 'local'").select(F.concat_ws("#", "path", F.col("routine_id").cast("string")).alias("routine_id"), "name")


def unit_uses(all_facts: DataFrame) -> DataFrame:
    """(unit, used)."""
    return all_facts.where("kind = 'uses'").select("unit", F.col("name").alias("used")).distinct()
