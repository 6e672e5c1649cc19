"""Fingerprints, priorities, levels and other code mappings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinals and texts of the enumerations, and weights of the triage list.
EDGE_KINDS = ["project", "contains", "interface", "implementation"]
RESOLUTIONS = ["resolved", "unresolved", "parserProblem"]
ACCESS_KINDS = ["read", "write", "readwrite"]
SYMBOL_KINDS = ["var", "threadvar", "typedconst", "classvar"]
LINT_PRIORITY = {"W": 300, "C": 200, "O": 100}
ANALYZER_PRIORITY = {"strong-warning": 300, "warning": 200, "exception": 150, "hint": 100}
STRONG_SPELLINGS = ["strong-warning", "strong_warning", "strongwarning"]
SARIF_OF_SEVERITY = {"strong-warning": "warning"}
SARIF_OF_LINT = {"W": "warning"}
EXIT_OF_FAILURE = {
    "invalidInput": 3, "toolNotFound": 3, "checkFailed": 30, "generatedProjectMissing": 31, "injectFilesMissing": 32, "projectPatchFailed": 33,
    "buildFailed": 34, "validatorNotFound": 35, "validatorFailed": 36, "generatorIncompatible": 37,
}
TOOL_CODE_FIRST = ["checkFailed", "buildFailed", "validatorFailed", "generatorIncompatible"]
LOOKUP_DEFINITION = ["Undeclared identifier", "Identifier not found", "Undeclared field", "Undeclared method", "Undeclared member"]


def ordinal(value: Column, names: list[str]) -> Column:
    """The place of a name in an enumeration, or null."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(names):
        out = F.when(value == name, F.lit(i)).otherwise(out)
    return out


def name_of(value: Column, names: list[str]) -> Column:
    """The name at a place of an enumeration, or null."""
    return F.get(F.array(*[F.lit(x) for x in names]), value)


def pick(value: Column, table: dict[str, object], default: object) -> Column:
    out = F.lit(default)
    for key, result in table.items():
        out = F.when(value == key, F.lit(result)).otherwise(out)
    return out


def fingerprint(*fields: Column) -> Column:
    """SHA-1 of the fields joined by bars; a missing field counts as empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))


def lint_priority(kind: Column) -> Column:
    return pick(F.upper(kind), LINT_PRIORITY, 50)


def analyzer_priority(severity: Column, section: Column, message: Column | None = None, with_call_tree: bool = False) -> Column:
    """Weight of an analyzer finding; exceptions from call trees rank last unless ``with_call_tree``."""
    low = F.lower(F.trim(severity))
    base = F.when(low.isin(STRONG_SPELLINGS), ANALYZER_PRIORITY["strong-warning"]).otherwise(pick(low, ANALYZER_PRIORITY, 80))
    if with_call_tree:
        return base
    tree = F.lit(False)
    for part in (section, message):
        if part is not None:
            tree = tree | F.contains(F.lower(F.coalesce(part, F.lit(""))), F.lit("call tree"))
    return F.when((low == "exception") & tree, 10).otherwise(base)


def sarif_level(severity: Column) -> Column:
    return pick(F.lower(severity), SARIF_OF_SEVERITY, "note")


def sarif_level_of_lint(kind: Column) -> Column:
    return pick(F.upper(kind), SARIF_OF_LINT, "note")


def sarif_uri(path: Column) -> Column:
    """A path with forward slashes and without dot segments; null if empty, a lone dot or leading out of the root."""
    p = F.translate(F.trim(path), "\\", "/")
    folded = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(x))),
        lambda acc: F.concat(F.when(F.startswith(p, F.lit("/")), "/").otherwise(""), F.array_join(acc, "/")),
    )
    return F.when((p != "") & (p != ".") & ~F.startswith(folded, F.lit("../")), folded)


def content_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes, to tell equal contents."""
    return F.sha2(content, 256)


def file_stamp(modified: Column) -> Column:
    return F.date_format(modified, "yyyyMMddHHmmssSSS")


def build_status(timed_out: Column, exit_code: Column, output_locked: Column, warnings: Column, hints: Column) -> Column:
    """timeout, error, output_locked, warnings, hints or ok, in this order."""
    return (
        F.when(timed_out, "timeout").when(exit_code != 0, "error").when(output_locked, "output_locked").when(warnings > 0, "warnings").when(hints > 0, "hints").otherwise("ok")
    )


def exit_code(failure: Column, tool_code: Column) -> Column:
    """The exit code for a kind of failure: a tool's own code without one, or if it says more; 1 for other kinds."""
    own = (failure == "none") | (failure.isin(TOOL_CODE_FIRST) & (tool_code != 0))
    return F.when(own, tool_code).otherwise(pick(failure, EXIT_OF_FAILURE, 1))


def filter_text(unused: bool = False, reads: bool = False, writes: bool = False, unit: str | None = None, name: str | None = None) -> str:
    """Which symbols a report shows, in words; ``all`` without a filter."""
    parts = [text for on, text in ((unused, "unused-only"), (reads, "reads-only"), (writes, "writes-only")) if on]
    parts += [f"{key}={value}" for key, value in (("unit", unit), ("name", name)) if value is not None]
    return ";".join(parts).strip() or "all"


def enrichment_operation(message: Column, token: Column, enclosing: Column) -> Column:
    """Which lookup helps to explain a compiler message: definition of what is undeclared, hover for the rest, symbols without a token; null for none."""
    low = F.lower(message)
    undeclared = F.lit(False)
    for text in LOOKUP_DEFINITION:
        undeclared = undeclared | F.contains(low, F.lit(text.lower()))
    return F.when(token == "", F.when(enclosing != "", "symbols")).when(undeclared, "definition").otherwise("hover")


def hotspot_hint(kind: Column) -> Column:
    """Advice for an edge in a cycle: implementation uses are easier to move."""
    return F.when(kind == "implementation", "easier").when(kind == "interface", "harder").otherwise("neutral")


def hotspot_rank_of_kind(kind: Column) -> Column:
    return F.when(kind == "implementation", 0).when(kind == "interface", 1).otherwise(ordinal(kind, EDGE_KINDS) + 10)


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(False))
