"""Markdown reports, paths and small lookups on rows of our own."""

from pyspark.sql import functions as F

from codelode.functions import codes, text
from codelode.operators import graph, project_state as state
from codelode.sinks import markdown, render
from codelode.sources import files

LINT = "code string, path string, line int, col int, message string"
ANALYZER = "severity string, section string, module string, path string, line int, message string"


def values(document):
    return [r.value for r in document.orderBy("ordinal").collect()]


def test_triage_groups_by_kind_and_path(spark):
    lint = spark.createDataFrame([("O9", "z.pas", 1, 1, "o"), ("W2", "b.pas", 5, None, "two"), ("W1", "b.pas", 9, 2, "one"), ("W1", "a.pas", None, 1, None), ("X1", "skip/x.pas", 1, 1, "x"), ("X1", None, 1, 1, "x")], LINT)
    analyzer = spark.createDataFrame([("warning", "s", "M", None, 3, "w"), ("Strong-Warning", "t", "N", "n.pas", 4, "sw"), (None, None, None, None, None, None)], ANALYZER)
    got = values(markdown.triage_report("T", "now", lint, analyzer, top=4, exclude=["skip/*"]))
    assert got == [
        "# T triage", "", "- Timestamp: now", "- Lint findings: 5 (showing top 4)", "- Analyzer findings: 3 (showing top 3)", "", "## Lint", "### W findings (defects)",
        "#### `a.pas`", "- [W1] ?:1 - ", "", "#### `b.pas`", "- [W1] 9:2 - one", "- [W2] 5:? - two", "", "### C findings (maintainability)", "No findings.", "", "### O findings (hygiene)", "#### `z.pas`", "- [O9] 1:1 - o", "",
        "## Analyzer", "### `n.pas`", "- [Strong-Warning] 4 - t: sw", "", "### `M`", "- [warning] 3 - s: w", "", "### `?`", "- [] ? - : ",
    ]
    nothing = values(markdown.triage_report("T", "now", lint.limit(0), analyzer.limit(0)))
    assert nothing[-4:] == ["## Lint", "No lint findings.", "", "## Analyzer"] or nothing[-1] == "No analyzer findings."


def test_summaries_and_baseline(spark):
    runs = spark.createDataFrame([], "kind string, path string, exit_code int, present boolean")
    counts = spark.createDataFrame([("W1", 3), ("C1", 5)], "code string, n long")
    pal = spark.createDataFrame([("root", 2, "", "9.1", "Delphi 12 (Win32)", 4, 1, 0)], "output_root string, exit_code int, report_root string, version string, compiler string, warnings int, strong_warnings int, exceptions int")
    got = values(markdown.project_summary("P", "p", "o", "now", runs, counts, pal, ["lost"]))
    assert got[8:11] == ["- Report files: (none)", "- Exit codes: (none)", "- Findings (by code): (TXT not generated)"]
    assert got[14:] == ["- Output root: `root`", "- Exit code: 2", "- Version: 9.1", "- Compiler target: Delphi 12 (Win32)", "- Totals: warnings=4, strong_warnings=1, exceptions=0", "", "## Errors", "", "- lost"]
    assert values(markdown.unit_summary("U", "u.pas", "o", "now", pal))[-2:] == ["- Analyzer version: 9.1", "- Compiler target: Delphi 12 (Win32)"]
    base = values(markdown.baseline_report("B", "now", "b.json", "s.md", {"platform": "Win32"}, counts, {"warnings": 4}, counts.withColumnRenamed("code", "section")))
    assert base[5] == "- Context: platform=Win32, config=?, delphi=?" and base[7:12] == ["## Lint", "- Findings: 8", "- Top codes:", "  - C1: 5", "  - W1: 3"]
    assert base[-5:] == ["## Analyzer", "- Totals: warnings=4, strong_warnings=?, exceptions=?", "- Top warning sections:", "  - C1: 5", "  - W1: 3"]


def test_no_changed_files(spark):
    none = spark.createDataFrame([], "path string")
    lint = spark.createDataFrame([(1, "W1", "a.pas", 1, 1, "m")], f"seq long, {LINT}")
    analyzer = spark.createDataFrame([(1, "s", "a", 1, "m")], "seq long, section string, module string, line int, message string")
    assert [r.value for r in markdown.changed_report("T", "now", none, lint, analyzer).collect()][-2:] == ["", "No changed files detected."]


def test_paths(spark):
    rows = [("/mnt/D", "D:\\"), ("/MNT/d/a//b/", "D:\\a\\b"), ("/mnt/dd/x", None), ("/mnt/", None), ("/home/x", None), ("", None), (None, None), ("..\\..\\x", "C:\\x"), ("c:\\a\\.\\b", "c:\\a\\b"), ("\\\\s\\h", "\\\\s\\h\\")]
    got = spark.createDataFrame(rows, "raw string, expected string").withColumn("got", text.absolute_path(F.col("raw"), "C:\\work")).collect()
    assert [(r.raw, r.got) for r in got] == [(r.raw, r.expected) for r in got]
    assert codes.filter_text() == "all" and codes.filter_text(unused=True, writes=True, unit="U*", name="g") == "unused-only;writes-only;unit=U*;name=g"


def test_small_lookups(spark):
    found = spark.createDataFrame([("macro", "DELPHI"), ("macro", "X"), ("path", "c:\\gen\\a"), ("path", "c:\\src")], "kind string, value string")
    left = state.without_ignored(found, ["delphi"], text.matches_any_mask(F.col("value"), ["*\\gen\\*"]))
    assert {r.value for r in left.collect()} == {"X", "c:\\src"}
    there = spark.createDataFrame([("C:/a/B.pas",)], "path string")
    asked = spark.createDataFrame([("c:/A/b.PAS",), ("c:/a",), ("c:/z",)], "path string")
    assert {r.path for r in state.existing_paths(asked, there).collect()} == {"c:/A/b.PAS", "c:/a"}
    marks = spark.createDataFrame([(True, True, None), (True, False, None)], "a boolean, b boolean, c boolean")
    assert [r.ok for r in marks.select(state.has_enough_markers([F.col("a"), F.col("b"), F.col("c")]).alias("ok")).collect()] == [True, False]
    files = spark.createDataFrame([("f", "b"), ("f", "a"), ("g", "c")], "folder string, path string")
    assert {(r.folder, r.path) for r in state.first_sorted(files).collect()} == {("f", "a"), ("g", "c")}
    edges = spark.createDataFrame([("b", "A", "interface"), ("B", "a", "implementation"), ("a", "c", "contains")], "src string, dst string, edge_kind string")
    assert [(r.src, r.edge_kind) for r in graph.sort_edges(edges).collect()] == [("a", "contains"), ("b", "interface"), ("B", "implementation")]


def test_handlers_and_promoted_warnings(spark):
    handlers = spark.createDataFrame([("M", "TF", "Go"), ("M", "TF", "Go"), ("M", None, "Stop"), ("N", "TF", "Go")], "file string, class string, method string")
    lines = spark.createDataFrame([("M", 1, "procedure Go(x);"), ("M", 7, "procedure tf.go(x);"), ("M", 8, "function Stop: Integer;")], "file string, line_no int, text string")
    got = sorted((r.file, r.method, r.declaration_line) for r in state.handler_declaration(handlers, lines).collect() if r.declaration_line)
    assert got == [("M", "Go", 7), ("M", "Go", 7), ("M", "Stop", 8)] and state.handler_declaration(handlers, lines).count() == 4
    warnings = spark.createDataFrame([("a", "w"), ("b", "w"), ("c", "w")], "path string, text string")
    diagnosed = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "path string, hit int")
    assert [(r.path, r.hit) for r in state.promoted_warnings(warnings, diagnosed).collect()] == [("a", 1)]


def test_dependency_text(spark):
    edges = spark.createDataFrame([("A", "B", "interface"), ("B", "A", "implementation"), ("A", "System.X", "interface")], "src string, dst string, edge_kind string")
    hot = spark.createDataFrame([("A", "B", 2, "harder"), ("B", "A", 5, "easier")], "src string, dst string, rank int, hint string")
    nodes = spark.createDataFrame([("A", 0), ("B", 0), ("System.X", 1), ("Lost", 1)], "name string, resolution_rank int")
    lines = lambda **k: [(r.section, r.value) for r in render.dependency_lines(edges, hot, nodes, **k).orderBy("section", "ordinal", "value").collect()]
    assert lines(top=1) == [
        ("edges", "A -> B [interface]"), ("edges", "A -> System.X [interface]"), ("edges", "B -> A [implementation]"), ("hotspots", "B -> A rank 5 (easier)"),
        ("unresolved", "Lost"), ("unresolved", "(1 framework units hidden)"),
    ]
    assert [v for s, v in lines(hide_framework=False) if s == "unresolved"] == ["Lost", "System.X"]
    members = spark.createDataFrame([(1, "A"), (1, "B")], "scc_id long, name string")
    focused = lambda unit: sorted((r.section, r.value) for r in render.focus_lines(edges, members, unit).collect())
    assert focused("b") == [("cycles", "A, B"), ("uses", "A [implementation]")] and focused("Lost") == [("cycles", "none"), ("uses", "none")]


def test_both_decoders_agree(spark):
    for raw in (bytes(range(256)), "\ufeffäß€".encode(), "€".encode("cp1252"), b"", b"\x81\x9f"):
        got = spark.createDataFrame([(bytearray(raw),)], "content binary").select(files.file_text(F.col("content")).alias("t")).first().t
        assert got == files.decode(raw)


def test_small_texts(spark):
    rows = spark.createDataFrame([("", " ", "k", "_a1", True), (None, "n", "k", "1a", False)], "id string, name string, kind string, word string, is_error boolean")
    got = rows.select(
        text.first_filled(F.col("id"), F.col("name"), F.col("kind")).alias("first"), text.is_valid_identifier(F.col("word")).alias("ok"),
        *[text.emit_source_context(m, F.col("is_error")).alias(m) for m in ("on", "off", "auto")],
    ).collect()
    assert [tuple(r) for r in got] == [("k", True, True, False, True), ("n", False, True, False, False)]
