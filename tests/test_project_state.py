"""Caches, lookups and guidance."""

from pyspark.sql import functions as F

from codelode.functions import text
from codelode.operators import project_state as state
from codelode.operators import relations
from codelode.sources import reports


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_cache_round_trip(spark, tmp_path):
    files = frame(spark, [("a.pas", "20260101", 10), ("b.pas", "20260102", 20)], "path string, stamp string, size long")
    symbols = frame(spark, [(2, "B"), (1, "A")], "symbol_id long, name string")
    refs = frame(spark, [(1, 5, 1), (9, 1, 1), (1, 2, 2)], "symbol_id long, line int, col int")
    amb = frame(spark, [("a.pas", 1, 1)], "file string, line int, col int")
    root = str(tmp_path / "cache")
    assert state.read_cache(spark, root, files) is None
    state.write_cache(root, files, symbols, refs, amb)
    got = state.read_cache(spark, root, files)
    assert [r.symbol_id for r in got["symbols"].collect()] == [1, 2] and [(r.symbol_id, r.line) for r in got["refs"].collect()] == [(1, 2), (1, 5)]
    assert state.read_cache(spark, root, files.where("size = 10")) is None
    assert state.read_cache(spark, root, files.union(frame(spark, [("c.pas", "1", 1)], files.schema))) is None
    one, two = (state.input_hash(x).first().hash for x in (files, files.orderBy(F.desc("path"))))
    assert one == two != state.input_hash(files.withColumn("size", F.col("size") + 1)).first().hash


def test_changed_files(spark):
    lines = frame(spark, [(" M src\\A.pas",), ('R  old.pas -> "new dir/B.pas"',), ("?? ./c.txt",), ("",)], "text string")
    changed = state.changed_files(lines)
    assert {r.path for r in changed.collect()} == {"src/A.pas", "new dir/B.pas", "c.txt"}
    assert {r.unit for r in state.changed_units(changed).collect()} == {"a", "b"}


def test_forms(spark):
    modules = frame(spark, [(1, "TMainForm", "Main", "Main.pas", "TMainForm"), (2, "TOther", "Other", "Other.pas", "TOther")], "ordinal int, resource string, unit string, file string, root_class string")
    assert state.requested_forms(modules, ["mainform.dfm"]).count() == 1 and state.requested_forms(modules, []).count() == 2
    failures = frame(spark, [("MAINFORM", "TMainForm", None, "BtnClick", "OnClick", "no such method")], "resource string, class string, member string, method string, event string, reason string")
    lines = frame(spark, [("Main.pas", 3, "procedure BtnClick(x);"), ("Main.pas", 9, "procedure TMainForm.BtnClick(x);")], "file string, line_no int, text string")
    assert state.failure_guidance(failures, modules, lines).first().guidance == "MAINFORM in Main: no such method (handler BtnClick) declared at Main.pas:9"
    assert [r.name for r in state.class_aliases(frame(spark, [("main",), ("x",)], "name string"), modules).orderBy("name").collect()] == ["TMainForm", "x"]


def test_versions_and_reports(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"10": "a", "12": "b", "x": "c"}')
    table = reports.version_map(spark, str(tmp_path / "v.json"))
    rows = frame(spark, [(9,), (10,), (11,), (13,)], "major int")
    assert [r.result for r in relations.as_of(rows, table).orderBy("major").collect()] == [None, "a", "a", "b"]
    help_ = frame(spark, [("use -cd12 or -cd10x or -cd9",)], "h string")
    assert help_.select(state.flag_for_version("h", [(9, "-cd9"), (10, "-cd10"), (12, "-cd12")], 11).alias("f")).first().f == "-cd9"
    md = frame(spark, [("s", "# T\n- Total: 7\n- W501: 3\n- C102: 4\n")], "path string, text string")
    assert reports.markdown_fields(md, {"total": r"^- Total: (\d+)$", "none": r"^- None: (.*)$"}).first().asDict() == {"path": "s", "total": "7", "none": None}
    assert {(r.code, r.n) for r in reports.markdown_counts(md).collect()} == {("W501", 3), ("C102", 4)}
    src = frame(spark, [("u", i, t) for i, t in enumerate(["const", "  A = 1;", "  B: Integer = 2;", "var", "  C: Integer = 3;"])], "path string, line_no int, text string")
    assert [(r["name"], r.type) for r in reports.typed_constants(src).collect()] == [("B", "Integer")]
    ctx = reports.run_context(frame(spark, [("p", ""), ("q", "1")], "key string, value string"), frame(spark, [("p", "2"), ("q", "3"), ("r", None)], "key string, value string"))
    assert {(r.key, r.value) for r in ctx.collect()} == {("p", "2"), ("q", "1"), ("r", "unknown")}


def test_scalar_functions(spark):
    row = frame(spark, [("  lX := Foo.Bar(1); // c 'x'", "C:\\r\\U.pas(12,3): error E1: 'Abc' lost", "Mod\\Sub (525)", "Parse (Proc)", "Delphi 12 (win32)")], "a string, b string, c string, d string, e string")
    got = row.select(
        text.identifier_at(F.col("a"), F.lit(4)).alias("at"), text.first_identifier(F.col("a")).alias("first"), text.quoted_identifier(F.col("b")).alias("quoted"), text.compiler_location(F.col("b")).alias("loc"),
        text.location(F.col("c")).alias("place"), text.complexity_name(F.col("d")).alias("cx"), text.compiler_target(F.col("e")).alias("target"), text.strip_comment(F.col("a")).alias("bare"),
        text.occurrences(F.col("a"), F.lit("foo")).alias("n"), text.word_position(F.col("a"), F.lit("BAR")).alias("pos"), text.xml_escape(F.lit("<a & 'b'>")).alias("xml"), text.looks_like_path(F.col("b")).alias("path"),
        text.chars_outside_quotes(F.lit("a<'<'<"), "<").alias("outside"), text.file_stem(F.lit("c:\\x\\A.B.pas")).alias("stem"), text.is_framework_unit(F.lit("system.Classes")).alias("fw"),
        text.in_directory(F.lit("C:/Repo/src/a.pas"), "c:\\repo").alias("inside"), text.slug(F.lit(" --Über x! ")).alias("slug"),
    ).first().asDict(recursive=True)
    assert got == {
        "at": "lX", "first": "lX", "quoted": "Abc", "loc": {"file": "C:\\r\\U.pas", "line": 12, "col": 3}, "place": {"module": "Mod\\Sub", "line": 525}, "cx": {"name": "Parse", "tag": "Proc", "is_routine": True},
        "target": {"compiler": "Delphi 12", "platform": "Win32"}, "bare": "  lX := Foo.Bar(1); ", "n": 1, "pos": 13, "xml": "&lt;a &amp; &apos;b&apos;&gt;", "path": True, "outside": 2, "stem": "A.B", "fw": True, "inside": True, "slug": "ber-x",
    }
