"""Markdown reports: project and unit summaries, triage lists, baselines.

A report is one project's. Its lists are top-k by nature, so their rows (and only those) reach the
driver, which lays out the text; counts are aggregated first. Lists without a natural bound stay distributed.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from codelode.functions.codes import analyzer_priority, lint_priority
from codelode.functions.text import path_allowed
from codelode.operators.project_state import changed_units
from codelode.operators.relations import only_changed, top_codes

# Headings of the kinds of lint findings.
LINT_HEADINGS = {"W": "W findings (defects)", "C": "C findings (maintainability)", "O": "O findings (hygiene)"}


def _document(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(ordinal, value), without blank lines at the end."""
    while lines and not lines[-1]:
        lines.pop()
    return spark.createDataFrame(list(enumerate(lines)), "ordinal long, value string")


def _errors(errors: list[str]) -> list[str]:
    return ["## Errors", "", *(f"- {e}" for e in errors), ""] if errors else []


def project_summary(title: str, project: str, outputs: str, timestamp: str, runs: DataFrame, counts: DataFrame, analyzer: DataFrame, errors: list[str] | None = None) -> DataFrame:
    """(ordinal, value): what the lint and analyzer runs of a project gave.

    ``runs`` (kind, path, exit_code, present) holds at most one row for each of txt, xml and csv that ran,
    ``counts`` (code, n) the lint findings, ``analyzer`` at most one row (output_root, exit_code, report_root,
    version, compiler, warnings, strong_warnings, exceptions). Null or empty fields leave their line out.
    """
    ran = {r.kind: r for r in runs.where(F.col("kind").isin("txt", "xml", "csv")).dropDuplicates(["kind"]).collect()}
    ran = {k: ran[k] for k in ("txt", "xml", "csv") if k in ran}
    lines = [f"# Static analysis summary: {title}", "", f"- Timestamp: {timestamp}", f"- Project: `{project}`", f"- Outputs: `{outputs}`", "", "## Lint", ""]
    lines.append("- Report files: " + (", ".join(f"{k}=`{r.path}`" for k, r in ran.items()) or "(none)"))
    lines.append("- Exit codes: " + (", ".join(f"{k}={r.exit_code}" for k, r in ran.items()) or "(none)"))
    missing = [k for k, r in ran.items() if not r.present]
    if missing:
        lines.append(f"- Note: some outputs are missing ({', '.join(missing)}).")
    if "txt" in ran and "txt" not in missing:
        lines.append(f"- Findings (by code): {counts.agg(F.sum('n')).first()[0] or 0}")
        top = top_codes(counts).collect()
        lines += ["- Top codes:", *(f"  - {r.code}: {r.n}" for r in top)] if top else []
    else:
        lines.append("- Findings (by code): (TXT not generated)")
    lines += ["", "## Analyzer", ""]
    one = analyzer.limit(1).collect()
    if one:
        a = one[0]
        lines += [f"- Output root: `{a.output_root}`", f"- Exit code: {a.exit_code}", *_analyzer_fields(a, "Version")]
        lines.append(f"- Totals: warnings={a.warnings}, strong_warnings={a.strong_warnings}, exceptions={a.exceptions}")
    else:
        lines.append("- Skipped.")
    return _document(runs.sparkSession, [*lines, "", *_errors(errors or [])])


def _analyzer_fields(a: Row, version: str) -> list[str]:
    named = (("Report folder", f"`{a.report_root}`", a.report_root), (version, a.version, a.version), ("Compiler target", a.compiler, a.compiler))
    return [f"- {name}: {text}" for name, text, value in named if value]


def unit_summary(unit: str, path: str, output: str, timestamp: str, analyzer: DataFrame, errors: list[str] | None = None) -> DataFrame:
    """(ordinal, value): where the analysis of one unit went; ``analyzer`` as for :func:`project_summary`."""
    lines = [f"# Analyzer unit summary: {unit}", "", f"- Timestamp: {timestamp}", f"- Unit: `{path}`", f"- Output: `{output}`"]
    for a in analyzer.limit(1).collect():
        lines += _analyzer_fields(a, "Analyzer version")
    return _document(analyzer.sparkSession, [*lines, "", *_errors(errors or [])])


def triage_report(title: str, timestamp: str, lint: DataFrame, analyzer: DataFrame, top: int = 20, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(ordinal, value): the ``top`` findings of each tool, those of lint by kind and path, the analyzer's by path.

    ``lint`` (code, path, line, col, message) and ``analyzer`` (severity, section, module, path, line, message); a missing
    path falls back to the module, missing fields show as a question mark. Equal findings follow their message and column.
    """
    kept = lambda df: df.where(path_allowed(F.col("path"), include or [], exclude or []))
    shown = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("?")).alias(c)
    number = F.coalesce(F.col("line").try_cast("int"), F.lit(0)).alias("at")
    blank = F.coalesce("message", F.lit("")).alias("message")
    a = kept(lint.select(lint_priority(F.left("code", F.lit(1))).alias("priority"), shown("code"), shown("path"), shown("line"), shown("col"), blank, number))
    path = F.coalesce(F.nullif("path", F.lit("")), F.nullif("module", F.lit("")), F.lit("?")).alias("path")
    rank = analyzer_priority(F.coalesce("severity", F.lit("")), F.col("section"), F.col("message")).alias("priority")
    b = kept(analyzer.select(rank, F.trim(F.coalesce("severity", F.lit(""))).alias("severity"), path, shown("line"), F.coalesce("section", F.lit("")).alias("section"), blank, number))
    first_a = a.orderBy(F.desc("priority"), "code", "path", "at", "message", "col").limit(top).collect()
    first_b = b.orderBy(F.desc("priority"), "severity", "path", "at", "message", "section").limit(top).collect()
    lines = [f"# {title} triage", "", f"- Timestamp: {timestamp}", f"- Lint findings: {(n := a.count())} (showing top {min(top, n)})"]
    lines += [f"- Analyzer findings: {(n := b.count())} (showing top {min(top, n)})", "", "## Lint"]
    if not first_a:
        lines += ["No lint findings.", ""]
    else:
        kind_of = lambda r: r.code[:1].upper() if r.code[:1].upper() in LINT_HEADINGS else ""
        for kind, heading in [*LINT_HEADINGS.items(), ("", "Other findings")]:
            rows = [r for r in first_a if kind_of(r) == kind]
            if not rows and not kind:
                continue
            lines.append(f"### {heading}")
            lines += [] if rows else ["No findings.", ""]
            lines += _by_path(rows, "####", lambda r: f"- [{r.code}] {r.line}:{r.col} - {r.message}")
    lines.append("## Analyzer")
    lines += [] if first_b else ["No analyzer findings."]
    lines += _by_path(first_b, "###", lambda r: f"- [{r.severity}] {r.line} - {r.section}: {r.message}")
    return _document(lint.sparkSession, lines)


def _by_path(rows: list[Row], mark: str, text) -> list[str]:
    """Rows under their paths, the paths in order of first appearance."""
    order = {p: i for i, p in reversed(list(enumerate(r.path for r in rows)))}
    out: list[str] = []
    for path, group in groupby(sorted(rows, key=lambda r: order[r.path]), key=lambda r: r.path):
        out += [f"{mark} `{path}`", *map(text, group), ""]
    return out


def changed_report(title: str, timestamp: str, changed: DataFrame, lint: DataFrame, analyzer: DataFrame, cap: int = 200) -> DataFrame:
    """(part, ordinal, value), in this order a document: changed files, then the findings in them, at most ``cap`` listed for each tool.

    ``changed`` (path); ``lint`` (seq, code, path, line, col, message) counts by path, ``analyzer`` (seq, section, module,
    line, message) by the stem of a changed source file. The list of files isn't bounded, so it stays distributed.
    """
    spark, files = changed.sparkSession, changed.select("path").where("path <> ''").distinct()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?" if c in ("code", "line", "col") else ""))
    a = only_changed(lint, files).select("seq", F.concat(F.lit("- ["), text("code"), F.lit("] "), "path", F.lit(":"), text("line"), F.lit(":"), text("col"), F.lit(" - "), text("message")).alias("value"))
    units = changed_units(files)
    b = analyzer.join(units, F.lower(F.trim("module")) == F.col("unit"), "left_semi")
    b = b.select("seq", F.concat(F.lit("- ["), text("section"), F.lit("] "), F.trim("module"), F.lit(":"), text("line"), F.lit(" - "), text("message")).alias("value"))
    n = files.count()
    head = [f"# {title} (changed files)", "", f"- Timestamp: {timestamp}", f"- Changed files: {n}", ""]
    fixed = [(0, i, v) for i, v in enumerate(head if n else [*head, "No changed files detected."])]
    if n:
        fixed += [(1, -1, "## Changed files"), (2, -1, "")]
    out = spark.createDataFrame([], "part int, ordinal long, value string")
    if n:
        out = files.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("ordinal"), F.concat(F.lit("- `"), "path", F.lit("`")).alias("value"))
        for part, name, rows in ((3, "Lint", a), (5, "Analyzer", b)):
            fixed += [(part, -2, f"## {name} (changed files)"), (part, -1, f"- Findings: {rows.count()}"), (part + 1, -1, "")]
            first = rows.orderBy("seq", "value").limit(cap)
            out = out.union(first.select(F.lit(part).alias("part"), F.col("seq").cast("long").alias("ordinal"), "value"))
    return spark.createDataFrame(fixed, "part int, ordinal long, value string").union(out).orderBy("part", "ordinal", "value")


def baseline_report(title: str, timestamp: str, baseline: str, summary: str, context: dict[str, str], counts: DataFrame, totals: dict[str, int], sections: DataFrame) -> DataFrame:
    """(ordinal, value): what a baseline holds. ``counts`` (code, n), ``sections`` (section, n); ten of each are shown."""
    lines = [f"# Static analysis baseline: {title}", "", f"- Timestamp: {timestamp}", f"- Baseline file: `{baseline}`", f"- Summary: `{summary}`"]
    if context:
        lines.append("- Context: " + ", ".join(f"{k}={context.get(k, '?')}" for k in ("platform", "config", "delphi")))
    lines += ["", "## Lint", f"- Findings: {counts.agg(F.sum('n')).first()[0] or 0}"]
    top = top_codes(counts).collect()
    lines += ["- Top codes:", *(f"  - {r.code}: {r.n}" for r in top)] if top else []
    lines += ["", "## Analyzer"]
    if totals:
        lines.append("- Totals: " + ", ".join(f"{k}={totals.get(k, '?')}" for k in ("warnings", "strong_warnings", "exceptions")))
    worst = sections.orderBy(F.desc("n"), F.lower("section")).limit(10).collect()
    lines += ["- Top warning sections:", *(f"  - {r.section}: {r.n}" for r in worst)] if worst else []
    return _document(counts.sparkSession, lines)
