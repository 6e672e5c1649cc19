"""Parsers and report filters on small fixtures of our own."""

import json

import pytest

from codelode.operators import graph, relations
from codelode.sinks import render
from codelode.sources import analyzer, build_log, files, forms, language_server, lint, pascal, project

WARNINGS = """<?xml version="1.0"?><report><section name="Unused" count="2">
<name>Alpha</name><loc><locmod>Core.Main (12)</locmod></loc><loc><locmod>Core.Main</locmod><locline>40</locline></loc>
<item><id>Beta</id><kind>Func|x</kind><locmod>Core.Util\\Sub (7)</locmod></item>
<item><id>Gamma</id><loc><locmod>Core.Util (9)</locmod><kind>Read</kind></loc></item>
<loc><locline>3</locline></loc></section></report>"""
EXCEPTION = """<report><section name="Call tree"><branch><name>Top</name><called_by><name>A</name><locmod>M (1)</locmod>
<called_by><name>B</name><locmod>M (2)</locmod><called_by><name>C</name><locmod>N</locmod><locline>3</locline></called_by></called_by></called_by></branch></section></report>"""


def as_files(spark, rows):
    return spark.createDataFrame([(p, bytearray(t.encode() if isinstance(t, str) else t)) for p, t in rows], "path string, content binary")


def as_lines(spark, text, path="r"):
    return spark.createDataFrame([(path, i + 1, x) for i, x in enumerate(text.split("\n"))], "path string, line_no int, text string")


def test_lines_decode_and_number(spark):
    rows = files.lines(as_files(spark, [("a", b"\xef\xbb\xbfone\r\ntwo\n"), ("b", "caf\xe9".encode("cp1252")), ("c", "")])).orderBy("path", "line_no").collect()
    assert [(r.path, r.line_no, r.text) for r in rows] == [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "café"), ("c", 1, "")]


def test_analyzer_findings(spark):
    got = files.parse_files(as_files(spark, [("x/Warnings.xml", WARNINGS), ("x/Exception.xml", EXCEPTION), ("x/Other.xml", "<a/>")]), analyzer.findings, analyzer.FINDING)
    rows = [(r.severity, r.module, r.line, r.message, r.id, r.kind) for r in got.orderBy("severity", "seq").collect()]
    assert rows == [
        ("exception", "M", 1, "A", None, None), ("exception", "M", 2, "B", None, None), ("exception", "N", 3, "C", None, None),
        ("warning", "Core.Main", 12, "Alpha", None, None), ("warning", "Core.Main", 40, "Alpha", None, None),
        ("warning", "Core.Util\\Sub", 7, "Beta", "Beta", "Func/x"), ("warning", "Core.Util", 9, "Gamma", "Gamma", "Read"),
    ]
    again = render.read_finding_lines(render.finding_lines(got)).collect()
    assert len(again) == 7 and {(r.module, r.line) for r in again} == {(x[1], x[2]) for x in rows}


def test_complexity_and_totals(spark):
    xml = """<report><section name="Complexity per module/subprogram"><module_or_subprogram><name>Parse(Proc)</name><lines_of_code>211</lines_of_code><dp>65</dp></module_or_subprogram>
    <module_or_subprogram><name>Core.Main</name><lines_of_code>526</lines_of_code><dp>136</dp></module_or_subprogram>
    <module_or_subprogram><name>Overall</name><dp>999</dp></module_or_subprogram><module_or_subprogram><name>Zero</name><dp>0</dp></module_or_subprogram></section></report>"""
    raw = files.parse_files(as_files(spark, [("Complexity.xml", xml)]), analyzer.complexity, analyzer.ENTRY)
    top = relations.top_hotspots(analyzer.complexity_entries(raw)).orderBy("is_routine").collect()
    assert [(r["name"], r.dp, r.loc, r.is_routine) for r in top] == [("Core.Main", 136, 526, False), ("Parse", 65, 211, True)]
    totals = "<r><section><module><name>A</name><item><kind>lines</kind><total>5</total></item></module><module><name>a</name><item><kind>lines</kind><total>7</total></item></module><module><name>B</name><item><kind>lines</kind><total>0</total></item></module></section></r>"
    rows = files.parse_files(as_files(spark, [("t", totals)]), analyzer.module_totals, "path string, seq int, module string, lines int")
    assert [(r.module, r.lines) for r in analyzer.module_lines(rows).collect()] == [("a", 7)]


@pytest.mark.parametrize(
    ("line", "kept"),
    [("D:\\shop\\Tax.pas,7,3,O201,unused unit", 1), ("D:\\shop\\Tax.pas,7,3,w733,unused unit", 0), ("D:\\shop\\Tax.pas;7;3;W733;a, b, c", 0), ('"D:\\shop\\Tax.pas",7,3,O201,"W733, twice"', 1)],
)
def test_csv_filter(spark, line, kept):
    assert lint.filter_csv(as_lines(spark, line + "\n"), [], ["W733"], [line]).count() == kept


def test_csv_header_masks_and_fields(spark):
    text = 'File,Line,Col,Rule,Message\n"C:\\lib\\A.pas",1,2,W501,x\n"C:\\src\\B.pas",3,4,C102,"say ""hi"", you"'
    rows = as_lines(spark, text)
    assert [r.text[:8] for r in lint.filter_csv(rows, ["*\\lib\\*"], [], text.split("\n")[:2]).orderBy("line_no").collect()] == ["File,Lin", '"C:\\src\\']
    found = lint.csv_findings(rows.where("line_no = 3")).first()
    assert (found.code, found.line, found.col, found.message) == ("C102", 3, 4, 'say "hi", you')
    assert [r.d for r in rows.select(lint.delimiter(rows.text).alias("d")).collect()] == [",", ",", ","]


def test_lint_text(spark):
    text = "head\nFile: src\\A.pas\n  W501 bad thing (10, 2)\n  C102 long (11, 3)\nFile: lib\\B.pas\n  W502 x (1, 1)\nFile: src\\C.pas\n  W501 y (2, 2)"
    rows = as_lines(spark, text)
    assert [(r.code, r.file, r.line, r.col) for r in lint.text_findings(rows).orderBy("code", "line").collect()][:2] == [("C102", "src\\A.pas", 11, 3), ("W501", "src\\C.pas", 2, 2)]
    assert [r.text for r in lint.filter_text(rows, ["lib\\*"], ["W501"]).collect()] == ["head", "File: src\\A.pas", "  C102 long (11, 3)"]


def test_lint_xml(spark):
    xml = '<r><file name="a\\X.pas"><message id="W501"/><message id="C1"/></file><file name="b\\Y.pas"><message id="W501"/></file></r>'
    rows = files.parse_files(as_files(spark, [("l.xml", xml)]), lint.xml_messages, lint.XML_MESSAGE)
    assert [(r.file, [m.id for m in r.messages]) for r in lint.filter_xml(rows, [], ["W501"]).collect()] == [("a\\X.pas", ["C1"])]


FORM = """object MainForm: TMainForm
  Caption = 'Main'
  Lines.Strings = (
    'a'
    'b')
  Columns = <
    item
      Title.Caption = 'A > B'
    end>
  Data = {
    00FF}
  Hint = 'one' +
    'two'
  OnCreate = FormCreate
  object Btn: TButton
    Left = 16
    OnClick = BtnClick
  end
end
"""


def test_forms(spark):
    rows = files.parse_files(as_files(spark, [("f", FORM)]), forms.components, forms.NODE)
    main, button = rows.orderBy("ordinal").collect()
    assert main.props == {"Caption": "'Main'", "Lines.Strings": "('a', 'b')", "Columns": "< item Title.Caption = 'A > B' end>", "Data": "{...binary data...}", "Hint": "'one' 'two'"}
    assert (main.events, button.events, button.parent_id, button.depth, button.start_line, button.end_line) == ({"OnCreate": "FormCreate"}, {"OnClick": "BtnClick"}, 0, 1, 15, 18)
    shown = [x for r in forms.tree_lines(rows).collect() for x in r.lines]
    assert shown == ["MainForm: TMainForm", "  Caption = 'Main'", "  OnCreate = FormCreate", "  Btn: TButton", "    Left = 16", "    OnClick = BtnClick"]
    assert {(r["class"], r.n) for r in forms.class_counts(rows).collect()} == {("TMainForm", 1), ("TButton", 1)}
    assert forms.property_line(rows, "btn", "left").first().line == 16


LOG = r"""Building the warehouse
D:\shop\ui\Basket.pas(88,14): hint H2164: 'Total' is assigned but never used
D:\shop\ui\Basket.pas(91): warning W1036: 'Sum' might not be initialized
D:\shop\gen\Codes.pas(2): error E2029: expected ';'
D:\other\Tax.pas(7,1): error E2010: incompatible types
ui\Basket.pas(120): hint H2443: inline function not expanded
D:\shop\ui\Basket.pas(130,2): warning W1057: implicit string cast
done in 3 s"""


def test_build_log(spark):
    rows = spark.createDataFrame([("all", i, x) for i, x in enumerate(LOG.split("\n"))], "stream string, line_no int, raw string")
    found = build_log.findings(rows, "D:\\shop", ["w1057"], ["gen\\*"])
    assert [(r["class"], r.code, r.file, r.line) for r in found.orderBy("line_no").collect()] == [
        ("hint", "H2164", "ui\\Basket.pas", 88), ("warning", "W1036", "ui\\Basket.pas", 91), ("error", None, "D:\\other\\Tax.pas", 7), ("hint", "H2443", "ui\\Basket.pas", 120)]
    assert build_log.counts(found).first().asDict() == {"errors": 1, "warnings": 1, "hints": 2}
    doc = json.loads(render.build_document(build_log.counts(found), build_log.listed(found, 1)).first().value)
    assert doc["hints"] == 2 and doc["findings"]["hint"] == ["ui\\Basket.pas(88,14): hint H2164: 'Total' is assigned but never used"]


STORE = """unit Shop.Store;
interface
uses Shop.Types, Data.Rows;
const
  Version = '2';
  Shelves: array[0..1] of string = ('left', 'right');
type
  TStore = class
  public
    class var
      fOpened, fClosed: Integer;
    function Room: Integer;
  end;
var
  Pallets, Carts: Integer;
threadvar
  Clerk: string;
implementation
function TStore.Room: Integer;
begin
  Result := Pallets;
  Inc(fOpened);
end;
end.
"""
REPORT = """unit Shop.Report;
interface
implementation
uses Shop.Store;
procedure Print(Carts: Integer);
var
  Line: string;
begin
  Line := Shelves[0] + Clerk;
  Pallets := Carts;
  // Clerk := 'nobody';
end;
procedure Reset;
begin
  Pallets := 0; { fClosed := 1 }
end;
end.
"""


def test_globals(spark):
    facts = pascal.read(as_files(spark, [("Shop.Store.pas", STORE), ("Shop.Report.pas", REPORT)])).cache()
    symbols = pascal.symbols(facts)
    kinds = {"Shelves": "typedconst", "fOpened": "classvar", "fClosed": "classvar", "Pallets": "var", "Carts": "var", "Clerk": "threadvar"}
    assert {r["name"]: r["kind"] for r in symbols.collect()} == kinds
    usages = relations.without_locals(pascal.usages(facts), pascal.routine_locals(facts))
    refs, ambiguous = relations.resolve_usages(usages, symbols, pascal.unit_uses(facts))
    refs = refs.cache()
    every = relations.filter_symbols(symbols, refs)
    assert relations.symbol_summary(symbols, refs, every, ambiguous).first().asDict() == {"total": 6, "used": 4, "unused": 2, "emitted": 6, "ambiguities": 0}
    assert {r["name"] for r in relations.filter_symbols(symbols, refs, access="writes").collect()} == {"Pallets"}  # a parameter hides Carts
    assert {r["name"] for r in relations.filter_symbols(symbols, refs, unused=True).collect()} == {"fClosed", "Carts"}
    with pytest.raises(ValueError):
        relations.filter_symbols(symbols, refs, access="reads", unused=True)
    missing = pascal.dependency_nodes(facts).where("resolution_rank = 1").select("name").collect()
    assert {r["name"] for r in missing} == {"Shop.Types", "Data.Rows"}


def unit(name, interface=(), implementation=()):
    uses = lambda xs: f"uses {', '.join(xs)};\n" if xs else ""
    return (f"{name}.pas", f"unit {name};\ninterface\n{uses(interface)}implementation\n{uses(implementation)}end.\n")


def test_dependency_cycles(spark):
    sources = [unit("Orders", ["Prices", "Mail.Client"], ["Stock"]), unit("Prices", [], ["Taxes"]), unit("Taxes", ["Rates"]), unit("Rates", [], ["Prices"]), unit("Stock", ["Stock"]), unit("Ship", ["Pack"]), unit("Pack", [], ["Ship", "Orders"])]
    facts = pascal.read(as_files(spark, sources)).cache()
    nodes, edges = graph.merge_nodes(pascal.dependency_nodes(facts)), graph.distinct_edges(pascal.uses_edges(facts))
    members = graph.cycle_components(nodes, edges)
    inner = graph.internal_edges(edges, members)
    assert {r.cycle for r in graph.representative_cycles(inner, members).collect()} == {"Prices -> Taxes -> Rates -> Prices", "Stock -> Stock", "Pack -> Ship -> Pack"}
    assert {(r["name"], r.score) for r in graph.unit_scores(inner).collect()} >= {("Stock", 2), ("Taxes", 2), ("Ship", 2)}
    top = graph.sort_hotspot_edges(graph.hotspot_edges(inner)).first()
    assert (top.edge_kind, top["rank"], top.hint) == ("implementation", 4, "easier")
    out, cycles = graph.focus(edges, members, "pack")
    assert out.count() == 2 and cycles.count() == 1
    assert graph.graph_counts(nodes, edges, nodes.limit(0)).first().asDict() == {"nodes": 8, "resolved": 7, "unresolved": 1, "edges": 10, "problems": 0}


PROJECT = """<Project><PropertyGroup><MainSource>S.dpr</MainSource><CfgDependentOn>S.optset</CfgDependentOn><Def>BASE;$(Def)</Def></PropertyGroup>
<PropertyGroup Condition="'$(Config)'=='Debug'"><Def>DEBUG;$(Def)</Def></PropertyGroup>
<PropertyGroup Condition="'$(Platform)'=='Win32' and '$(Nope)'==''"><Def>W32;$(Def)</Def></PropertyGroup></Project>"""
OPTSET = "<Project><PropertyGroup><Def>OPT</Def></PropertyGroup></Project>"


def test_project_overlay(spark):
    rows = spark.createDataFrame([("p/S.dproj", {"p/S.dproj": PROJECT, "p/S.optset": OPTSET})], "project string, files map<string,string>")
    props = project.properties(rows, {"Config": "Debug", "Platform": "Win32"})
    last = relations.overlay(props.where("name = 'Def'")).first()
    assert (last.value, last.source) == ("W32;DEBUG;BASE;OPT", "p/S.dproj")
    assert project.resolved_lists(props, ["Def"]).first()["items"] == ["W32", "DEBUG", "BASE", "OPT"]
    assert project.main_source(PROJECT) == "S.dpr"


@pytest.mark.parametrize(
    ("text", "value"),
    [("'a'=='A'", True), ("'a'=='b'or'c'=='c'", True), ("'a' != 'b' and true", True), ("!Exists('x')", True), ("Exists('there')", True), ("HasTrailingSlash(a b\\)", True), ("not HasTrailingSlash('a')", True), ("true or false and false", True), ("", True), ("('a'=='b' or 'a'=='a') and false", False)],
)
def test_conditions(text, value):
    assert project.holds(text, {}, {}, lambda p: p == "there") is value


@pytest.mark.parametrize("text", ["'a'=='a' junk", "'a'=='a' =", "'a", "'a' ==", "('a'=='a'"])
def test_bad_conditions(text):
    with pytest.raises(project.ProjectError):
        project.holds(text, {}, {})


def test_macros_and_imports():
    assert project.expand("$(A)-$(x)-$(b", {"A": "1$(B)", "B": "2$(A)"}, {"X": "e"}) == "12$(A)-e-$(b"
    assert project.expand("[$(Q)]", {}, {}, unknown_empty=True) == "[]"
    loop = {"a": '<P><Import Project="b"/></P>', "b": '<P><Import Project="a"/></P>'}
    with pytest.raises(project.ProjectError):
        list(project.evaluate("a", loop.get, {}))


def test_language_server(spark):
    one = {"uri": "file:///C%3A/My%20Src/a+b.pas", "range": {"start": {"line": 4, "character": 2}, "end": {"line": 4, "character": 9}}}
    rows = spark.createDataFrame([(1, json.dumps(one)), (2, json.dumps([one, one])), (3, "null")], "id int, body string")
    got = language_server.locations(rows).orderBy("id", "ordinal").collect()
    assert len(got) == 3 and (got[0].file, got[0].line, got[0].col, got[0].end_col) == ("C:\\My Src\\a+b.pas", 5, 3, 10)
    tree = json.dumps([{"name": "T", "kind": 5, "range": {"start": {"line": 1, "character": 0}}, "children": [{"name": "M", "kind": 6, "range": {"start": {"line": 2, "character": 1}}}]}])
    symbols = files.parse_files(as_files(spark, [("u", tree)]), language_server.symbol_tree, language_server.SYMBOL)
    assert [(r["name"], r.container, r.line) for r in language_server.sorted_symbols(symbols).collect()] == [("T", "", 2), ("M", "T", 3)]
    hover = spark.createDataFrame([(json.dumps({"contents": {"value": "x: Integer"}}),), (json.dumps({"contents": ["a", {"value": "b"}]}),)], "b string")
    assert [r.h for r in hover.select(language_server.hover_text(hover.b).alias("h")).collect()] == ["x: Integer", "a\nb"]


def test_sarif(spark):
    a = spark.createDataFrame([("W501", "src\\A.pas", "", 3, 4, "m"), ("C1", "..\\out.pas", "", 1, 1, "n")], "code string, path string, file string, line int, col int, message string")
    b = spark.createDataFrame([("strong-warning", "Dead code", "a/./b/../C.pas", 9, "X", None)], "severity string, section string, path string, line int, message string, id string")
    doc = json.loads(render.sarif(render.sarif_results(a, b)).first().value)
    assert doc["version"] == "2.1.0" and len(doc["runs"]) == 2
    results = {r["ruleId"]: r for run in doc["runs"] for r in run["results"]}
    assert set(results) == {"W501", "analyzer.dead-code"}
    assert results["analyzer.dead-code"]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a/C.pas"
    assert results["analyzer.dead-code"]["message"]["text"] == "Dead code: X"


def test_streamed_history(spark, tmp_path):
    from codelode.streaming import logs

    src = tmp_path / "in"
    src.mkdir()
    (src / "out.log").write_text("a.pas(1): error E1: x\nok\nb.pas(2): warning W1: y\n")
    found = logs.log_stream(spark, str(src)).selectExpr("stream", "raw")
    q = logs.append_history(found, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    counted = logs.finding_counts(logs.log_stream(spark, str(src)))
    q = counted.writeStream.format("memory").queryName("kinds").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["class"], r.n) for r in spark.table("kinds").collect()} == {("error", 1), ("warning", 1)}
