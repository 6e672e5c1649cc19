"""Renderers and writers: JSON, JSON lines, Markdown, SARIF, parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.codes import sarif_level, sarif_level_of_lint, sarif_uri
from codelode.functions.text import is_framework_unit, one_line, slug, xml_escape
from codelode.operators.graph import focus


def finding_lines(findings: DataFrame) -> DataFrame:
    """One text column: ``severity | report | section | module:line | message``, in order of seq."""
    place = F.concat("module", F.lit(":"), F.col("line").cast("string"))
    parts = [one_line(F.col(c)) for c in ("severity", "report", "section")] + [place, one_line(F.col("message"))]
    return findings.orderBy("seq").select(F.concat_ws(" | ", *parts).alias("value"))


def read_finding_lines(lines: DataFrame) -> DataFrame:
    """The columns of :func:`finding_lines` again."""
    p = F.split("value", r" \| ", 5)
    at = lambda i: F.get(p, F.lit(i))
    return lines.where("value <> ''").select(
        at(0).alias("severity"), at(1).alias("report"), at(2).alias("section"), F.regexp_extract(at(3), r"^(.*):(-?\d+)$", 1).alias("module"),
        F.regexp_extract(at(3), r"^(.*):(-?\d+)$", 2).cast("int").alias("line"), at(4).alias("message"),
    )


def write_text(lines: DataFrame, path: str) -> None:
    """A folder of text parts; order within parts follows the plan."""
    lines.write.mode("overwrite").text(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines without null fields; columns whose name starts with an underscore stay out."""
    rows.select(*[c for c in rows.columns if not c.startswith("_")]).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def hotspot_lines(routines: DataFrame, modules: DataFrame, module_lines: DataFrame) -> DataFrame:
    """(ordinal, value): three lists under headings; an empty list says none. The lists are top-k, so they are small."""
    out = None
    for i, (title, rows, text) in enumerate((
        ("Routines", routines, F.format_string("- %s (dp %d, lines %d)", "name", "dp", "loc")),
        ("Modules", modules, F.format_string("- %s (dp %d, lines %d)", "name", "dp", "loc")),
        ("Module lines", module_lines, F.format_string("- %s (%d lines)", "module", "lines")),
    )):
        body = rows.agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("a")).select(F.transform("a", lambda x: x["t"]).alias("a"))
        body = body.select(F.concat(F.array(F.lit(f"## {title}")), F.when(F.size("a") == 0, F.array(F.lit("- none"))).otherwise(F.col("a"))).alias("a"))
        part = body.select(F.posexplode("a").alias("pos", "value")).select((F.lit(i * 1000) + F.col("pos")).alias("ordinal"), "value")
        out = part if out is None else out.union(part)
    return out


def _result(rule: Column, level: Column, message: Column, uri: Column, line: Column, col: Column) -> Column:
    region = F.struct(F.coalesce(line, F.lit(1)).alias("startLine"), F.coalesce(col, F.lit(1)).alias("startColumn"))
    place = F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region"))
    return F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"))


def sarif_results(lint: DataFrame, analyzer: DataFrame) -> DataFrame:
    """(tool, rule_id, rule_text, result): one SARIF result per finding with a relative path; scales with the findings."""
    lint_uri = sarif_uri(F.coalesce(F.nullif(F.col("path"), F.lit("")), F.col("file")))
    a = lint.withColumn("_u", lint_uri).where("_u is not null and trim(code) <> ''")
    message = F.coalesce(F.nullif(F.trim("message"), F.lit("")), F.col("code"))
    a = a.select(
        F.lit("lint").alias("tool"), F.col("code").alias("rule_id"), F.concat(F.lit("Rule "), "code").alias("rule_text"),
        _result(F.col("code"), sarif_level_of_lint(F.left("code", F.lit(1))), message, F.col("_u"), F.col("line"), F.col("col")).alias("result"),
    )
    section, ident = F.trim(F.coalesce("section", F.lit(""))), F.trim(F.coalesce("id", "message", F.lit("")))
    text = F.when((section != "") & (ident != ""), F.concat(section, F.lit(": "), ident)).otherwise(F.coalesce(F.nullif(section, F.lit("")), F.nullif(ident, F.lit("")), F.lit("Analyzer finding")))
    rule = F.concat(F.lit("analyzer."), slug(section))
    b = analyzer.withColumn("_u", sarif_uri(F.col("path"))).where("_u is not null")
    b = b.select(F.lit("analyzer").alias("tool"), rule.alias("rule_id"), F.coalesce(F.nullif(section, F.lit("")), F.lit("Analyzer finding")).alias("rule_text"),
                 _result(rule, sarif_level(F.col("severity")), text, F.col("_u"), F.col("line"), F.lit(1)).alias("result"))
    return a.union(b)


def sarif(results: DataFrame) -> DataFrame:
    """One row with the SARIF 2.1.0 document (value). A report is one project's, so it fits a row; bulk data stays in :func:`sarif_results`."""
    rules = F.array_sort(F.collect_set(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("rule_text").alias("text")).alias("shortDescription"))))
    runs = results.groupBy("tool").agg(rules.alias("rules"), F.collect_list("result").alias("results"))
    run = F.struct(F.struct(F.struct(F.col("tool").alias("name"), "rules").alias("driver")).alias("tool"), "results")
    doc = runs.agg(F.collect_list(run).alias("runs")).where(F.size("runs") > 0)
    return doc.select(F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), "runs")).alias("value"))


def dependency_document(nodes: DataFrame, edges: DataFrame, cycles: DataFrame, hotspots: DataFrame, problems: DataFrame) -> DataFrame:
    """One row (value): the dependency report of one project as JSON."""
    rows = lambda df, name, *cols: df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = rows(nodes, "nodes", "name", "path", "resolution_rank").crossJoin(rows(edges, "edges", "src", "dst", "edge_kind"))
    out = out.crossJoin(rows(cycles, "cycles", "scc_id", "cycle")).crossJoin(rows(hotspots, "hotspots", "rank", "src", "dst", "hint")).crossJoin(rows(problems, "problems", "unit", "file", "description"))
    return out.select(F.to_json(F.struct(*out.columns)).alias("value"))


def dependency_lines(edges: DataFrame, hotspots: DataFrame, nodes: DataFrame | None = None, top: int = 20, hide_framework: bool = True) -> DataFrame:
    """(section, ordinal, value): edges, unresolved units and the top hotspots as text, each section in order; ``top`` 0 is all.

    ``nodes`` (name, resolution_rank) gives the units without a source (rank 1); those of the framework are only
    counted if ``hide_framework``. Rows sorted by all three columns are the text; hotspots carry their negative rank as ordinal.
    """
    e = edges.select(F.lit("edges").alias("section"), F.format_string("%s -> %s [%s]", "src", "dst", "edge_kind").alias("value"), F.lit(0).alias("ordinal"))
    out = e
    if nodes is not None:
        lost = nodes.where("resolution_rank = 1")
        shown = lost.where(~is_framework_unit(F.col("name"))) if hide_framework else lost
        out = out.union(shown.select(F.lit("unresolved"), F.col("name"), F.lit(0)))
        if hide_framework:
            n = lost.where(is_framework_unit(F.col("name"))).agg(F.count("*").alias("n")).where("n > 0")
            out = out.union(n.select(F.lit("unresolved"), F.format_string("(%d framework units hidden)", "n"), F.lit(1)))
    h = hotspots.orderBy(F.desc("rank"), F.lower("src"), F.lower("dst"))
    h = (h.limit(top) if top > 0 else h).select(F.lit("hotspots"), F.format_string("%s -> %s rank %d (%s)", "src", "dst", "rank", "hint"), -F.col("rank").cast("int"))
    return out.union(h).select("section", "ordinal", "value")


def focus_lines(edges: DataFrame, members: DataFrame, unit: str) -> DataFrame:
    """(section, value): what a unit uses and the cycles that hold it; a section without rows says none."""
    uses, cycles = focus(edges, members, unit)
    u = uses.select(F.lit("uses").alias("section"), F.format_string("%s [%s]", "dst", "edge_kind").alias("value"))
    c = cycles.select(F.lit("cycles").alias("section"), F.array_join("members", ", ").alias("value"))
    heads = edges.sparkSession.createDataFrame([("uses",), ("cycles",)], "section string")
    return heads.join(u.union(c), "section", "left").select("section", F.coalesce("value", F.lit("none")).alias("value"))


def symbol_document(symbols: DataFrame) -> DataFrame:
    """JSON of each symbol with its references (value)."""
    return symbols.select(F.to_json(F.struct(*symbols.columns)).alias("value"))


def symbol_lines(symbols: DataFrame) -> DataFrame:
    """``unit.name: type (kind) file:line`` lines with the number of references."""
    n = F.coalesce(F.size("used_by"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return symbols.select(F.format_string("%s.%s: %s (%s) %s:%d refs %d", "unit", "name", "type", "kind", "file", "line", n).alias("value"))


def delta_lines(delta: DataFrame, title: str) -> DataFrame:
    """A Markdown table of a count delta."""
    head = delta.sparkSession.createDataFrame([(0, f"## {title}"), (1, "| Key | Before | After | Δ |"), (2, "| --- | ---: | ---: | ---: |")], "ordinal long, value string")
    rows = delta.agg(F.array_sort(F.collect_list(F.struct((-F.abs("delta")).alias("o"), F.col(delta.columns[0]).cast("string").alias("k"), "before", "after", "delta"))).alias("a"))
    rows = rows.select(F.posexplode("a").alias("pos", "x")).select((F.col("pos") + 3).cast("long").alias("ordinal"), F.format_string("| %s | %d | %d | %+d |", "x.k", "x.before", "x.after", "x.delta").alias("value"))
    return head.union(rows)


def trend_lines(history: DataFrame, metrics: list[str], show: int = 20) -> DataFrame:
    """Markdown rows of the last runs (summary_timestamp, metrics and their deltas); a missing value is a question mark, a missing delta is empty."""
    cells = [F.col("summary_timestamp")]
    for m in metrics:
        cells.append(F.coalesce(F.col(m).cast("string"), F.lit("?")))
        d = F.col(f"{m}_delta")
        cells.append(F.when(d.isNull(), "").when(d == 0, "0").otherwise(F.format_string("%+d", d)))
    last = history.orderBy(F.desc("summary_timestamp")).limit(show)
    return last.orderBy("summary_timestamp").select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def parameter_ini(params: DataFrame) -> DataFrame:
    """``name=a;b;c`` lines of (name, items)."""
    return params.select(F.concat("name", F.lit("="), F.array_join("items", ";")).alias("value"))


def parameter_xml(params: DataFrame) -> DataFrame:
    """One element per parameter with its items escaped."""
    items = F.array_join(F.transform("items", lambda x: F.concat(F.lit("<item>"), xml_escape(x), F.lit("</item>"))), "")
    return params.select(F.concat(F.lit('<param name="'), xml_escape(F.col("name")), F.lit('">'), items, F.lit("</param>")).alias("value"))


def build_document(counts: DataFrame, listed: DataFrame) -> DataFrame:
    """One row (value): counts and the capped findings of a build as JSON."""
    found = listed.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("ordinal", "display"))).alias("items"))
    every = found.agg(F.map_from_entries(F.collect_list(F.struct("class", F.transform("items", lambda x: x["display"])))).alias("findings"))
    return counts.crossJoin(every).select(F.to_json(F.struct("errors", "warnings", "hints", "findings")).alias("value"))


def with_snippets(listed: DataFrame, snippets: DataFrame) -> DataFrame:
    """Findings (class, ordinal, display) with their snippet lines appended, paired by ordinal."""
    s = snippets.groupBy("class", "ordinal").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("\n"), x["text"])), "")
    return listed.join(s, ["class", "ordinal"], "left").withColumn("display", F.concat("display", F.coalesce(body, F.lit("")))).drop("lines")


def semantic_hint(operation: Column, locations: Column, hover: Column, symbols: Column) -> Column:
    """One line: the first location, the hover text, or the first three symbol names."""
    first = F.get(locations, F.lit(0))
    place = F.concat(F.lit("defined at "), first["file"], F.lit(":"), first["line"].cast("string"))
    return F.when(operation == "definition", place).when(operation == "hover", F.concat(F.lit("type: "), one_line(hover))).when(
        operation == "symbols", F.concat(F.lit("symbols: "), F.array_join(F.slice(symbols, 1, 3), ", "))
    )


def envelope(operation: str, result: DataFrame) -> DataFrame:
    """One row (value): an operation's answer as JSON."""
    return result.agg(F.collect_list(F.struct(*result.columns)).alias("items")).select(
        F.to_json(F.struct(F.lit(operation).alias("operation"), F.size("items").alias("count"), "items")).alias("value")
    )
