"""Every registered query of the engine with the SQL that must give the same rows.

The synthetic tables stand in for the engine's relations: suppliers and customers
for units and symbols, line items for findings and references, orders for
routines and runs, parts for files and rules, events for log lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions import codes, text
from codelode.operators import graph, project_state, relations
from codelode.session import load
from codelode.sinks import markdown, render
from codelode.sources import build_log, forms, lint

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- masks, rules, lists --------------------------------------------------------


@query("""
SELECT p_partkey, p_name, p_type FROM part
WHERE (p_type ILIKE 'std%' OR p_type ILIKE '%eco?omy%' OR p_type ILIKE '%a%') AND NOT (p_brand ILIKE '%#1_')
""")
def mask_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    keep = text.matches_any_mask(F.col("p_type"), ["STD*", "*eco\\?omy*", "*a*"])
    return part.where(keep & ~text.matches_any_mask(F.col("p_brand"), ["*#1?"])).select("p_partkey", "p_name", "p_type")


@query("""
SELECT p_partkey, p_name FROM part
WHERE (lower(p_name) LIKE '%a%1%' OR lower(p_type) LIKE '%e%') AND NOT lower(p_brand) LIKE '%3'
""")
def path_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return part.where((text.path_allowed(F.col("p_name"), ["*a*1*"], []) | text.path_allowed(F.col("p_type"), ["*e*"], [])) & text.path_allowed(F.col("p_brand"), [], ["*3"])).select("p_partkey", "p_name")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'w' WHEN l_returnflag = 'N' THEN ' C' ELSE 'x' END || (500 + l_linenumber) AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, upper(trim(raw)) AS rule FROM c WHERE regexp_matches(upper(trim(raw)), '^[WCO][0-9]+$') AND upper(trim(raw)) NOT IN ('W501', 'C503')
""")
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("l_returnflag") == "A", "w").when(F.col("l_returnflag") == "N", " C").otherwise("x"), (F.col("l_linenumber") + 500).cast("string"))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.rule_id(raw).alias("rule"))
    return rows.where("rule is not null").where(~F.col("rule").isin("W501", "C503"))


@query("""
WITH c AS (SELECT upper(l_returnflag || l_linestatus) || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS raw FROM lineitem)
SELECT substr(raw, 2, 4) AS code, count(*) AS n FROM c WHERE regexp_matches(substr(raw, 2), '^[A-Z][0-9]{3}') GROUP BY 1 ORDER BY n DESC, lower(code) LIMIT 10
""")
def top_rule_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.substr(F.concat(F.upper(F.concat("l_returnflag", "l_linestatus")), F.lpad(F.col("l_linenumber").cast("string"), 3, "0")), F.lit(2))
    return relations.top_codes(relations.code_counts(load(spark, sf_dir, "lineitem").select(code.alias("code"))))


@query("""
WITH x AS (SELECT c_custkey, unnest(generate_series(1, 4)) AS pos, unnest([c_mktsegment, lower(c_mktsegment), c_name, upper(c_name)]) AS item FROM customer),
f AS (SELECT c_custkey, min(pos) AS pos, lower(item) AS k FROM x GROUP BY c_custkey, lower(item))
SELECT f.c_custkey, string_agg(x.item, ';' ORDER BY f.pos) AS merged FROM f JOIN x ON x.c_custkey = f.c_custkey AND x.pos = f.pos GROUP BY f.c_custkey
""")
def ordered_distinct_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws(";", "c_mktsegment", F.lower("c_mktsegment"), "c_name", F.upper("c_name"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.ordered_distinct(text.parse_list(raw)), ";").alias("merged"))


@query("""
SELECT p_partkey, trim(translate(p_name || chr(10) || p_brand || '|' || p_type, chr(13) || chr(10) || '|', '  /')) AS line,
  substr(regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS slug,
  p_brand AS module, p_size AS line_no FROM part
""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    at = text.location(F.concat("p_brand", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")")))
    line = text.one_line(F.concat("p_name", F.lit("\n"), "p_brand", F.lit("|"), "p_type"))
    return part.select("p_partkey", line.alias("line"), text.slug(F.concat("p_brand", F.lit(" / "), "p_type")).alias("slug"), at["module"].alias("module"), at["line"].alias("line_no"))


@query("""
SELECT l_orderkey, l_linenumber, sha1(coalesce(l_returnflag, '') || '|' || coalesce(l_linestatus, '') || '|' || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)) AS fingerprint FROM lineitem
""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = codes.fingerprint(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_partkey"), F.col("l_linenumber"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", f.alias("fingerprint"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'timeout' WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 11 = 0 THEN 'output_locked'
  WHEN o_orderkey % 3 > 0 THEN 'warnings' WHEN o_orderkey % 5 > 0 THEN 'hints' ELSE 'ok' END AS status FROM orders
""")
def build_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = codes.build_status(F.col("o_orderstatus") == "P", (k % 7 == 0).cast("int"), k % 11 == 0, k % 3, k % 5)
    return load(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


# ---- symbols and references --------------------------------------------------------

_USAGE_SQL = """
u AS (SELECT l_orderkey * 10 + l_linenumber AS usage_id, 'unit' || (l_suppkey % 40) AS unit, 'v' || (l_partkey % 1999) AS name FROM lineitem),
s AS (SELECT p_partkey AS symbol_id, 'UNIT' || (p_partkey % 40) AS unit, 'V' || (p_partkey % 1999) AS name FROM part),
uses AS (SELECT DISTINCT 'unit' || (l_suppkey % 40) AS unit, 'unit' || (l_partkey % 40) AS used FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45),
seen AS (SELECT unit, used FROM uses UNION SELECT unit, unit FROM u),
found AS (SELECT u.usage_id, u.unit, u.name, s.symbol_id, s.unit || '.' || s.name AS candidate FROM u JOIN s ON lower(u.name) = lower(s.name) JOIN seen ON seen.unit = u.unit AND lower(s.unit) = lower(seen.used)),
counted AS (SELECT *, count(*) OVER (PARTITION BY usage_id) AS n FROM found)
"""


def _usages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    item, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    unit = F.concat(F.lit("unit"), (F.col("l_suppkey") % 40).cast("string"))
    usages = item.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("usage_id"), unit.alias("unit"), F.concat(F.lit("v"), (F.col("l_partkey") % 1999).cast("string")).alias("name")
    )
    symbols = part.select(
        F.col("p_partkey").alias("symbol_id"), F.concat(F.lit("UNIT"), (F.col("p_partkey") % 40).cast("string")).alias("unit"), F.concat(F.lit("V"), (F.col("p_partkey") % 1999).cast("string")).alias("name")
    )
    uses = item.where("l_linenumber = 1 and l_quantity > 45").select(unit.alias("unit"), F.concat(F.lit("unit"), (F.col("l_partkey") % 40).cast("string")).alias("used"))
    return usages, symbols, uses


@query(f"WITH {_USAGE_SQL} SELECT usage_id, unit, name, symbol_id FROM counted WHERE n = 1")
def visible_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.resolve_usages(*_usages(spark, sf_dir))[0].select("usage_id", "unit", "name", "symbol_id")


@query(f"WITH {_USAGE_SQL} SELECT usage_id, unit, name, string_agg(candidate, '; ' ORDER BY candidate) AS candidates FROM counted WHERE n > 1 GROUP BY ALL")
def ambiguous_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.resolve_usages(*_usages(spark, sf_dir))[1].select("usage_id", "unit", "name", "candidates")


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND lower(o.o_orderstatus) = lower(l.l_linestatus))
""")
def without_locals(spark: SparkSession, sf_dir: str) -> DataFrame:
    usages = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("routine_id"), F.col("l_linestatus").alias("name"), "l_linenumber", "l_suppkey")
    local = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("routine_id"), F.col("o_orderstatus").alias("name"))
    return relations.without_locals(usages, local).select(F.col("routine_id").alias("l_orderkey"), "l_linenumber", "l_suppkey")


def _symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    symbols = c.select(F.col("c_custkey").alias("symbol_id"), F.col("c_mktsegment").alias("unit"), F.col("c_name").alias("name"))
    access = F.when(F.col("o_orderstatus") == "F", "write").when(F.col("o_orderstatus") == "O", "read").otherwise("readwrite")
    return symbols, o.select(F.col("o_custkey").alias("symbol_id"), access.alias("access"), F.col("o_orderkey").alias("line"))


@query("""
SELECT c_custkey AS symbol_id, c_mktsegment AS unit, c_name AS name FROM customer
WHERE c_mktsegment ILIKE '%u%' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'O')
""")
def symbols_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, refs = _symbols(spark, sf_dir)
    return relations.filter_symbols(symbols, refs, unit="u", access="writes")


@query("""
SELECT c_custkey AS symbol_id, c_mktsegment AS unit, c_name AS name FROM customer WHERE c_name ILIKE '%1%' AND c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def symbols_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, refs = _symbols(spark, sf_dir)
    return relations.filter_symbols(symbols, refs, name="*1*", unused=True)


@query("""
SELECT c_custkey AS symbol_id, count(o_orderkey) AS n_refs, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS lines
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def symbols_with_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, refs = _symbols(spark, sf_dir)
    out = relations.with_references(symbols, refs)
    n = F.when(F.col("used_by").isNull(), 0).otherwise(F.size("used_by"))
    return out.select("symbol_id", n.cast("long").alias("n_refs"), F.array_join(F.transform("used_by", lambda x: x["line"].cast("string")), ",").alias("lines"))


@query("""
WITH used AS (SELECT DISTINCT o_custkey FROM orders)
SELECT count(*) AS total, count(o_custkey) AS used, count(*) - count(o_custkey) AS unused,
  (SELECT count(*) FROM customer WHERE c_mktsegment ILIKE '%build%') AS emitted, (SELECT count(*) FROM region) AS ambiguities
FROM customer LEFT JOIN used ON o_custkey = c_custkey
""")
def symbol_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, refs = _symbols(spark, sf_dir)
    return relations.symbol_summary(symbols, refs, relations.filter_symbols(symbols, refs, unit="build"), load(spark, sf_dir, "region"))


# ---- findings -----------------------------------------------------------------------

_FINDING_KEY = ["l_returnflag", "l_linestatus", "module", "line"]


@query("""
WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_returnflag, l_linestatus, 'm' || (l_partkey % 50) AS module, CAST(l_quantity AS INT) AS line,
  CASE WHEN l_linenumber = 1 THEN '' ELSE 'msg' || l_linenumber END AS message FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, module, line ORDER BY seq) AS k FROM f)
SELECT seq, l_returnflag, l_linestatus, module, line, CASE WHEN message = '' THEN '-' ELSE message END AS message FROM r WHERE k = 1
""")
def distinct_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_returnflag", "l_linestatus", F.concat(F.lit("m"), (F.col("l_partkey") % 50).cast("string")).alias("module"),
        F.col("l_quantity").cast("int").alias("line"), F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("msg"), F.col("l_linenumber").cast("string"))).alias("message"),
    )
    return relations.distinct_findings(rows, _FINDING_KEY)


@query("""
SELECT l_returnflag AS section, n FROM (SELECT l_returnflag || '-' || (l_partkey % 23) AS l_returnflag, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS s FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
ORDER BY n DESC, s LIMIT 10
""")
def top_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("severity"), F.concat("l_returnflag", F.lit("-"), (F.col("l_partkey") % 23).cast("string")).alias("section"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    )
    return relations.top_sections(rows, "O")


@query("""
WITH e AS (SELECT p_name AS name, p_size AS dp, p_partkey AS loc, p_partkey % 2 = 0 AS is_routine, p_partkey % 10 = 1 AS is_aggregate FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY is_routine ORDER BY dp DESC, lower(name), loc) AS rank FROM e WHERE dp > 0 AND (is_routine OR NOT is_aggregate))
SELECT is_routine, rank, dp FROM r WHERE rank <= 20
""")
def complexity_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"), F.col("p_size").alias("dp"), F.col("p_partkey").alias("loc"), (F.col("p_partkey") % 2 == 0).alias("is_routine"), (F.col("p_partkey") % 10 == 1).alias("is_aggregate")
    )
    return relations.top_hotspots(rows).select("is_routine", F.col("rank").cast("long").alias("rank"), "dp")


@query("""
SELECT l_returnflag AS report, sum(coalesce(TRY_CAST(CASE WHEN l_linenumber = 1 THEN 'x' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS INT), 0)) AS total FROM lineitem GROUP BY 1
""")
def section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.when(F.col("l_linenumber") == 1, "x").otherwise(F.col("l_quantity").cast("int").cast("string"))
    return relations.section_totals(load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("report"), count.alias("count")))


_BEFORE = "SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1"
_AFTER = "SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1"


@query(f"""
WITH b AS ({_BEFORE}), a AS ({_AFTER})
SELECT coalesce(b.k, a.k) AS k, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta
FROM b FULL JOIN a ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0) ORDER BY abs(delta) DESC, k LIMIT 10
""")
def count_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_shipdate")
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    side = lambda test: item.where(test).groupBy("k").agg(F.count("*").alias("n"))
    return relations.count_delta(side(F.col("l_shipdate") < cut), side(F.col("l_shipdate") >= cut), "k")


@query("""
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'
  AND (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')
""")
def new_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    item = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", codes.fingerprint(F.col("l_partkey"), F.col("l_suppkey")).alias("fingerprint"))
    now, before = item.where(F.col("l_shipdate") >= cut), item.where(F.col("l_shipdate") < cut)
    return relations.new_items(now, before).select("l_partkey", "l_suppkey").distinct()


@query("""
WITH d AS (SELECT r_regionkey, CAST(r_regionkey AS INT) AS new_strong, CAST(r_regionkey * 2 AS INT) AS warnings_delta FROM region)
SELECT r_regionkey, new_strong <= 1 AND warnings_delta <= 4 AS ok,
  array_to_string(list_filter([CASE WHEN new_strong > 1 THEN 'New strong warnings: ' || new_strong || ' > 1' END, CASE WHEN warnings_delta > 4 THEN 'Warnings increase: ' || warnings_delta || ' > 4' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM d
""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    delta = load(spark, sf_dir, "region").select(key, key.cast("int").alias("new_strong"), F.lit(0).alias("new_lint_w"), (key * 2).cast("int").alias("warnings_delta"))
    reasons = relations.gate_reasons(new_strong=1, new_lint_w=None, warning_increase=4)
    return delta.select("r_regionkey", (F.size(reasons) == 0).alias("ok"), F.array_join(reasons, "; ").alias("reasons"))


@query("""
WITH l AS (SELECT 'lint' AS tool, CASE l_returnflag WHEN 'A' THEN 200 WHEN 'N' THEN 100 ELSE 300 END AS priority,
  CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'O' ELSE 'W' END || (500 + l_linenumber) AS label, 'u' || (l_partkey % 100) AS path, CAST(l_quantity AS INT) AS line, 'm' || l_orderkey AS message FROM lineitem),
a AS (SELECT 'analyzer' AS tool, CASE WHEN o_orderpriority LIKE '1%' THEN 300 WHEN o_orderpriority LIKE '2%' THEN 10 WHEN o_orderpriority LIKE '3%' THEN 200 ELSE 80 END AS priority,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'strong-warning' WHEN o_orderpriority LIKE '2%' THEN 'exception' WHEN o_orderpriority LIKE '3%' THEN 'warning' ELSE 'other' END AS label,
  'o' || (o_custkey % 100) AS path, CAST(o_orderkey % 1000 AS INT) AS line, 'x' || o_orderkey AS message FROM orders)
SELECT * FROM (SELECT * FROM l UNION ALL SELECT * FROM a) ORDER BY priority DESC, label, path, line, message, tool LIMIT 20
""")
def triage_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, kind = F.col("l_returnflag"), F.col("o_orderpriority")
    lint_rows = load(spark, sf_dir, "lineitem").select(
        F.concat(F.when(flag == "A", "C").when(flag == "N", "O").otherwise("W"), (F.col("l_linenumber") + 500).cast("string")).alias("code"),
        F.concat(F.lit("u"), (F.col("l_partkey") % 100).cast("string")).alias("path"), F.col("l_quantity").cast("int").alias("line"), F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("message"),
    )
    severity = F.when(kind.startswith("1"), "strong-warning").when(kind.startswith("2"), "exception").when(kind.startswith("3"), "warning").otherwise("other")
    analyzer = load(spark, sf_dir, "orders").select(
        severity.alias("severity"), F.lit("Exception Call Tree").alias("section"), F.concat(F.lit("o"), (F.col("o_custkey") % 100).cast("string")).alias("path"), F.lit("m").alias("module"),
        (F.col("o_orderkey") % 1000).cast("int").alias("line"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("message"),
    )
    return relations.triage(lint_rows, analyzer)


# ---- files, keyed lookups, intervals ---------------------------------------------------


@query("""
WITH files AS (SELECT lower(p_brand) AS stem, p_name || '/' || p_partkey AS path FROM part),
i AS (SELECT stem, path FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY length(path), path) AS k FROM files) WHERE k = 1)
SELECT p_partkey, i.path FROM part LEFT JOIN i ON lower(p_brand) = i.stem
""")
def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    files = part.select(F.col("p_brand").alias("stem"), F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    found = part.select("p_partkey", F.concat(F.upper("p_brand"), F.lit("\\Sub")).alias("module"))
    return relations.with_module_path(found, files).select("p_partkey", "path")


@query("""
WITH files AS (SELECT 'src/' || s_suppkey || '/Unit' || (s_suppkey % 60) || '.pas' AS path, 'unit' || (s_suppkey % 60) || '.pas' AS base FROM supplier),
u AS (SELECT base, min(path) AS path FROM files GROUP BY base HAVING count(*) = 1)
SELECT l_orderkey, l_linenumber, coalesce(u.path, 'C:\\x\\unit' || (l_suppkey % 120) || '.pas') AS file FROM lineitem LEFT JOIN u ON u.base = 'unit' || (l_suppkey % 120) || '.pas'
""")
def unique_basenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "supplier").select(F.concat(F.lit("src/"), F.col("s_suppkey").cast("string"), F.lit("/Unit"), (F.col("s_suppkey") % 60).cast("string"), F.lit(".pas")).alias("path"))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("C:\\x\\unit"), (F.col("l_suppkey") % 120).cast("string"), F.lit(".pas")).alias("file"))
    return relations.with_repo_path(rows, files, "file")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def changed_files_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = load(spark, sf_dir, "part").where("p_size < 5").select(F.col("p_partkey").alias("path"))
    return relations.only_changed(load(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "path"), changed).select("l_orderkey", "l_linenumber")


@query("""
WITH t AS (SELECT DISTINCT CAST(p_size AS INT) AS k, 'r' || p_size AS result FROM part WHERE p_size % 7 = 0)
SELECT c_custkey, (SELECT max_by(result, k) FROM t WHERE k <= c_custkey % 60) AS result FROM customer
""")
def as_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "part").where("p_size % 7 = 0").select(F.col("p_size").cast("int").alias("key"), F.concat(F.lit("r"), F.col("p_size").cast("string")).alias("result")).distinct()
    rows = load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 60).cast("int").alias("major"))
    return relations.as_of(rows, table).select("c_custkey", "result")


@query("""
SELECT o_custkey AS name, max_by(o_orderstatus, o_orderkey) AS value, max_by(o_orderpriority, o_orderkey) AS source FROM orders GROUP BY o_custkey
""")
def property_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("seq"))
    return relations.overlay(rows)


@query("""
WITH r AS (SELECT n_regionkey AS precedence, CASE WHEN n_nationkey % 2 = 0 THEN 'paths' ELSE 'mode' END AS key, n_name || ';' || lower(n_name) || ';' || 'x' || (n_nationkey % 3) AS value, n_nationkey FROM nation),
one AS (SELECT precedence, key, min_by(value, n_nationkey) AS value FROM r GROUP BY ALL),
i AS (SELECT precedence, generate_subscripts(string_split(value, ';'), 1) AS pos, unnest(string_split(value, ';')) AS item FROM one WHERE key = 'paths'),
f AS (SELECT lower(item) AS k, min(struct_pack(a := precedence, b := pos, c := item)) AS x FROM i GROUP BY 1)
SELECT 'paths' AS key, string_agg(x.c, ';' ORDER BY x) AS value FROM f UNION ALL SELECT 'mode', max_by(value, precedence) FROM one WHERE key = 'mode'
""")
def settings_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("n_nationkey"), F.col("n_name")
    rows = load(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("precedence"), F.when(key % 2 == 0, "paths").otherwise("mode").alias("key"), F.concat(name, F.lit(";"), F.lower(name), F.lit(";x"), (key % 3).cast("string")).alias("value"), key
    )
    rows = rows.groupBy("precedence", "key").agg(F.min_by("value", "n_nationkey").alias("value"))
    return relations.settings_cascade(rows, ["paths"])


@query("""
WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS finding_id, CAST(l_suppkey AS VARCHAR) AS file, CAST(l_quantity AS INT) AS line FROM lineitem),
s AS (SELECT CAST(s_suppkey AS VARCHAR) AS file, unnest(generate_series(1, 30)) AS line_no FROM supplier)
SELECT f.finding_id, f.file, s.line_no, s.line_no = f.line AS is_target FROM f JOIN s ON s.file = f.file AND s.line_no BETWEEN f.line - 2 AND f.line + 2
""")
def source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_id"), F.col("l_suppkey").cast("string").alias("file"), F.col("l_quantity").cast("int").alias("line")
    )
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("line_no")).withColumn("text", F.lit(""))
    return relations.lines_around(f, s).select("finding_id", "file", F.col("line_no").cast("long").alias("line_no"), "is_target")


@query("""
SELECT c.c_custkey, NOT coalesce(s.s_nationkey = c.c_nationkey AND s.s_suppkey % 3 <> 0 AND s.s_suppkey % 2 = 0, false) AS needs_work
FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey
""")
def cache_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("hash"))
    old = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("hash"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("r").alias("resource"), F.when(F.col("s_suppkey") % 2 == 0, "ok").otherwise("FAIL").alias("status")
    )
    return relations.changed_or_unknown(now, old, "c_custkey", ["hash"]).select("c_custkey", "needs_work")


# ---- order-dependent --------------------------------------------------------------------


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderkey % 50 AS BIGINT) END AS total FROM orders)
SELECT o_custkey, o_orderkey, total - last_value(total IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total_delta FROM r
""")
def trend_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey") % 50).alias("total"))
    return relations.trend(rows, ["total"], "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "total_delta")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events
""")
def header_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return relations.carry_forward(rows, F.when(F.col("event_type") == "click", F.col("event_id")), "header", "user_id", "event_id").select("event_id", "header")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS s FROM lineitem) WHERE s <= 60
""")
def snippet_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").withColumn("bytes", F.col("l_quantity").cast("long"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return relations.within_budget(rows, "bytes", order, 60, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
WITH h AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM h WHERE b IS NULL OR b <> event_type)
SELECT user_id, event_id FROM r WHERE k <= 5
""")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("summary_timestamp"))
    return relations.last_entries(rows, "user_id", "event_id", 5).select("user_id", "event_id")


@query("""
WITH h AS (SELECT o_custkey AS file, o_orderkey AS line, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'F'), t AS (SELECT o_custkey AS file, o_orderkey AS line FROM orders WHERE o_orderstatus <> 'F')
SELECT t.file, t.line, (SELECT max_by(name, h.line) FROM h WHERE h.file = t.file AND h.line <= t.line) AS enclosing FROM t
""")
def enclosing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("name"), "o_orderstatus")
    return relations.enclosing(o.where("o_orderstatus <> 'F'").select("file", "line"), o.where("o_orderstatus = 'F'").select("file", "line", "name"))


# ---- logs -------------------------------------------------------------------------------

_LOG_SQL = """
raw AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'err' ELSE 'out' END AS stream, event_id AS line_no,
  CASE event_id % 7 WHEN 0 THEN 'D:\\shop\\ui\\p' || (event_id % 11) || '.pas(' || (event_id % 200 + 1) || ',2): error E2029: expected a sign' WHEN 1 THEN 'linking'
   WHEN 2 THEN 'ui\\q.pas(' || (event_id % 50 + 1) || '): hint H' || (2160 + event_id % 4) || ': never used' WHEN 3 THEN 'gen\\codes.pas(3): error E2010: types'
   WHEN 4 THEN 'D:\\shop\\t.pas(6): warning W' || (1030 + event_id % 6) || ': not set' WHEN 5 THEN '[Error] no license' ELSE '' END AS raw FROM events)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    s = lambda c: c.cast("string")
    raw = (
        F.when(k % 7 == 0, F.concat(F.lit("D:\\shop\\ui\\p"), s(k % 11), F.lit(".pas("), s(k % 200 + 1), F.lit(",2): error E2029: expected a sign")))
        .when(k % 7 == 1, F.lit("linking"))
        .when(k % 7 == 2, F.concat(F.lit("ui\\q.pas("), s(k % 50 + 1), F.lit("): hint H"), s(k % 4 + 2160), F.lit(": never used")))
        .when(k % 7 == 3, F.lit("gen\\codes.pas(3): error E2010: types"))
        .when(k % 7 == 4, F.concat(F.lit("D:\\shop\\t.pas(6): warning W"), s(k % 6 + 1030), F.lit(": not set")))
        .when(k % 7 == 5, F.lit("[Error] no license"))
        .otherwise("")
    )
    return load(spark, sf_dir, "events").select(F.when(k % 3 == 0, "err").otherwise("out").alias("stream"), k.alias("line_no"), raw.alias("raw"))


_FOUND_SQL = f"""
WITH {_LOG_SQL}, d AS (SELECT stream, line_no, replace(raw, 'D:\\shop\\', '') AS display FROM raw WHERE raw NOT LIKE 'gen%'),
f AS (SELECT *, CASE WHEN display LIKE '%error%' OR display LIKE '[Error]%' THEN 'error' WHEN display LIKE '%warning W%' THEN 'warning' WHEN display LIKE '%hint H%' THEN 'hint' END AS class,
  nullif(regexp_extract(display, '([WH][0-9]+):', 1), '') AS code FROM d)
"""


@query(_FOUND_SQL + """
SELECT stream, line_no, class, code, nullif(regexp_extract(display, '^(.+)[(][0-9]', 1), '') AS file, TRY_CAST(regexp_extract(display, '[(]([0-9]+)', 1) AS INT) AS line, display
FROM f WHERE class IS NOT NULL AND coalesce(code, '') NOT IN ('W1031', 'H2162')
""")
def build_log_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_log.findings(_log(spark, sf_dir), "D:\\shop", ["W1031", "h2162"], ["gen\\*"]).select("stream", "line_no", "class", "code", "file", "line", "display")


@query(_FOUND_SQL + """
SELECT count(*) FILTER (class = 'error') AS errors, count(*) FILTER (class = 'warning') AS warnings, count(*) FILTER (class = 'hint') AS hints FROM f WHERE coalesce(code, '') NOT IN ('W1031', 'H2162')
""")
def build_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_log.counts(build_log.findings(_log(spark, sf_dir), "D:\\shop", ["W1031", "H2162"], ["gen\\*"]))


@query(_FOUND_SQL + """
, r AS (SELECT class, stream, line_no, row_number() OVER (PARTITION BY class ORDER BY CASE WHEN stream = 'err' THEN 0 ELSE 1 END, line_no) AS ordinal FROM f WHERE class IS NOT NULL)
SELECT class, ordinal, stream, line_no FROM r WHERE ordinal <= 5
""")
def build_log_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = build_log.listed(build_log.findings(_log(spark, sf_dir), "D:\\shop", [], ["gen\\*"]), 5)
    return out.select("class", F.col("ordinal").cast("long").alias("ordinal"), "stream", "line_no")


@query("""
WITH t AS (SELECT user_id AS path, event_id AS line_no, CASE event_id % 4 WHEN 0 THEN 'File: ' || CASE WHEN event_id % 8 = 0 THEN 'lib\\a' ELSE 'src\\b' END || (event_id % 5) || '.pas' WHEN 1 THEN '  W501 bad (3, 1)' WHEN 2 THEN '  C102 long (4, 2)' ELSE '  O801 odd (5, 3)' END AS text FROM events),
g AS (SELECT *, sum(CASE WHEN text LIKE 'File:%' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM t),
m AS (SELECT *, max(CASE WHEN text LIKE 'File:%' THEN CASE WHEN text LIKE 'File: lib%' THEN 1 ELSE 0 END END) OVER (PARTITION BY path, g) AS masked FROM g),
k AS (SELECT * FROM m WHERE (g = 0 OR masked = 0) AND (g = 0 OR text LIKE 'File:%' OR text NOT LIKE '%W501%')),
b AS (SELECT *, sum(CASE WHEN text LIKE 'File:%' THEN 0 ELSE 1 END) OVER (PARTITION BY path, g) AS body FROM k)
SELECT path, line_no, text FROM b WHERE g = 0 OR body > 0
""")
def lint_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    name = F.concat(F.lit("File: "), F.when(k % 8 == 0, "lib\\a").otherwise("src\\b"), (k % 5).cast("string"), F.lit(".pas"))
    line = F.when(k % 4 == 0, name).when(k % 4 == 1, "  W501 bad (3, 1)").when(k % 4 == 2, "  C102 long (4, 2)").otherwise("  O801 odd (5, 3)")
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("path"), k.alias("line_no"), line.alias("text"))
    return lint.filter_text(rows, ["lib\\*"], ["W501"])


# ---- graph ------------------------------------------------------------------------------

def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as units in blocks of twenty; an edge leads to a later unit of the block, a few returned items lead back."""
    item = load(spark, sf_dir, "lineitem")
    s, d = F.col("l_partkey") % 20, F.col("l_suppkey") % 20
    to = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), d).otherwise(F.greatest(s, d))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "interface").otherwise("implementation")
    name = lambda c: F.concat(F.lit("U"), c.cast("string"))
    e = item.select(name(F.col("l_partkey")).alias("src"), name(F.col("l_partkey") - s + to).alias("dst"), kind.alias("edge_kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.distinct_edges(e)


_EDGE_SQL = """
edges AS (SELECT DISTINCT 'U' || l_partkey AS src, 'U' || (l_partkey - l_partkey % 20 + CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN l_suppkey % 20 ELSE greatest(l_partkey % 20, l_suppkey % 20) END) AS dst,
  CASE WHEN l_linenumber % 2 = 0 THEN 'interface' ELSE 'implementation' END AS edge_kind FROM lineitem),
names AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges),
adj AS (SELECT DISTINCT src, dst FROM edges),
reach(a, b) AS (SELECT src, dst FROM adj UNION SELECT reach.a, adj.dst FROM reach JOIN adj ON adj.src = reach.b),
scc AS (SELECT n.name, least(n.name, min(f.b)) AS root FROM names n LEFT JOIN reach f ON f.a = n.name AND EXISTS (SELECT 1 FROM reach g WHERE g.a = f.b AND g.b = n.name) GROUP BY n.name),
sizes AS (SELECT root, count(*) AS n, max(CASE WHEN EXISTS (SELECT 1 FROM adj WHERE src = scc.name AND dst = scc.name) THEN 1 ELSE 0 END) AS loop FROM scc GROUP BY root),
ids AS (SELECT root, row_number() OVER (ORDER BY root) AS scc_id FROM sizes WHERE n > 1 OR loop = 1),
members AS (SELECT name, scc_id FROM scc JOIN ids USING (root)),
inner_edges AS (SELECT e.*, a.scc_id FROM edges e JOIN members a ON a.name = e.src JOIN members b ON b.name = e.dst WHERE a.scc_id = b.scc_id),
scores AS (SELECT name, scc_id, count(*) AS score FROM (SELECT src AS name, scc_id FROM inner_edges UNION ALL SELECT dst, scc_id FROM inner_edges) GROUP BY ALL)
"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _edges(spark, sf_dir)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("name")).distinct().select("name", F.lit(True).alias("is_project_unit"), F.lit(0).alias("resolution_rank"))
    return nodes, e


@query(f"WITH RECURSIVE {_EDGE_SQL} SELECT src, dst, edge_kind FROM edges")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("src", "dst", "edge_kind")


@query(f"WITH RECURSIVE {_EDGE_SQL} SELECT 'U1' AS start, b AS node FROM reach WHERE a = 'U1' UNION SELECT 'U1', 'U1'")
def reachable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_edges(spark, sf_dir), spark.createDataFrame([("U1",)], "name string"))


@query(f"WITH RECURSIVE {_EDGE_SQL} SELECT name, CAST(scc_id AS INT) AS scc_id FROM members")
def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e = _graph(spark, sf_dir)
    return graph.cycle_components(nodes, e).select("name", "scc_id")


@query(f"WITH RECURSIVE {_EDGE_SQL} SELECT name, score FROM scores")
def unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e = _graph(spark, sf_dir)
    return graph.unit_scores(graph.internal_edges(e, graph.cycle_components(nodes, e))).select("name", "score")


@query(f"""WITH RECURSIVE {_EDGE_SQL}
SELECT e.src, e.dst, e.edge_kind, CAST(e.scc_id AS INT) AS scc_id, a.score + b.score AS rank, CASE e.edge_kind WHEN 'implementation' THEN 'easier' ELSE 'harder' END AS hint
FROM inner_edges e JOIN scores a ON a.name = e.src JOIN scores b ON b.name = e.dst""")
def hotspot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e = _graph(spark, sf_dir)
    return graph.sort_hotspot_edges(graph.hotspot_edges(graph.internal_edges(e, graph.cycle_components(nodes, e))))


@query(f"WITH RECURSIVE {_EDGE_SQL} SELECT CAST(scc_id AS INT) AS scc_id, string_agg(name, ',' ORDER BY name) AS members, count(*) AS n FROM members GROUP BY scc_id")
def cycle_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e = _graph(spark, sf_dir)
    out = graph.sort_components(graph.cycle_components(nodes, e))
    return out.select("scc_id", F.array_join("members", ",").alias("members"), "n")


@query()
def representative_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e = _graph(spark, sf_dir)
    members = graph.cycle_components(nodes, e)
    return graph.representative_cycles(graph.internal_edges(e, members), members)


@query("""
SELECT s_name AS name, min(s_suppkey) AS first_seq, max(CAST(s_nationkey % 3 AS INT)) AS resolution_rank, bool_or(s_suppkey % 2 = 0) AS is_project_unit
FROM (SELECT 'S' || (s_suppkey % 30) AS s_name, s_suppkey, s_nationkey FROM supplier) GROUP BY 1
""")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), (key % 30).cast("string")).alias("name"), key.cast("string").alias("path"), (key % 2 == 0).alias("is_project_unit"), (F.col("s_nationkey") % 3).cast("int").alias("resolution_rank"), key.alias("seq")
    )
    return graph.merge_nodes(rows).select("name", F.col("path").cast("long").alias("first_seq"), "resolution_rank", "is_project_unit")


@query("""
SELECT 0 AS source_ordinal, n_name AS name FROM nation UNION ALL SELECT 1, r_name FROM region
""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.ordered_union(load(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), load(spark, sf_dir, "region").select(F.col("r_name").alias("name"))).select("source_ordinal", "name")


@query("""
SELECT p_brand AS path, string_agg(p_size || ':' || p_name, ';' ORDER BY p_size, p_name) AS items FROM part GROUP BY p_brand
""")
def grouped_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_size").alias("line"), F.col("p_name").alias("message"))
    out = relations.grouped_for_display(rows, "path")
    return out.select("path", F.array_join(F.transform("items", lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["message"])), ";").alias("items"))


@query("""
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem QUALIFY k <= 7
""")
def capped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relations.capped(load(spark, sf_dir, "lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber"], 7)
    w = Window.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("k"))


# ---- more lookups, parsers and renderers ---------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, 'W' || (500 + l_linenumber) AS code, 'C:\\r\\u' || (l_suppkey % 50) || '.pas' AS file, CAST(l_quantity AS INT) AS line, 'say "' || l_returnflag || '", ok' AS message
FROM lineitem
""")
def csv_lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = load(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    line = F.concat(
        F.lit('"C:\\r\\u'), (F.col("l_suppkey") % 50).cast("string"), F.lit('.pas",'), F.col("l_quantity").cast("int").cast("string"), F.lit(",1, w"), (F.col("l_linenumber") + 500).cast("string"), F.lit(',"say ""'), s("l_returnflag"), F.lit('"", ok"')
    )
    rows = item.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("path"), line.alias("text"))
    return lint.csv_findings(rows).select("path.*", "code", "file", "line", "message")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ';' WHEN p_partkey % 3 = 1 THEN ',' END AS sep FROM part
""")
def csv_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, 'a;"b,,,,";c,d;e').when(k == 1, F.concat("p_name", F.lit(',"x;y;z;w",2;3'))).otherwise("no marks here")
    return load(spark, sf_dir, "part").select("p_partkey", lint.delimiter(line).alias("sep"))


@query("""
SELECT p_partkey, 'src\\' || p_partkey || '.pas' AS file, p_size AS line, CASE WHEN p_size % 2 = 0 THEN p_size + 1 END AS col, 'ID' || p_size AS quoted, 'lName' || p_size AS at_col FROM part
""")
def message_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    place = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(","), (F.col("p_size") + 1).cast("string"))).otherwise(size)
    line = F.concat(F.lit("src\\"), F.col("p_partkey").cast("string"), F.lit(".pas("), place, F.lit("): error E2003: Undeclared 'ID"), size, F.lit("'"))
    at = text.compiler_location(line)
    ident = text.identifier_at(F.concat(F.lit("  lName"), size, F.lit(" := 1")), F.lit(5))
    return load(spark, sf_dir, "part").select("p_partkey", at["file"].alias("file"), at["line"].alias("line"), at["col"].alias("col"), text.quoted_identifier(line).alias("quoted"), ident.alias("at_col"))


@query("""
WITH c AS (SELECT o_orderkey AS id, o_orderkey % 4 AS prio, 'p' || (o_orderkey % 4) || '/' || (o_custkey % 50) AS path FROM orders UNION ALL SELECT o_orderkey, 9, 'late/' || (o_custkey % 70) FROM orders),
f AS (SELECT DISTINCT 'P' || (s_suppkey % 3) || '/' || (s_suppkey % 40) AS path FROM supplier UNION SELECT 'LATE/' || s_suppkey FROM supplier),
b AS (SELECT id, min_by(path, prio) AS path FROM c WHERE lower(path) IN (SELECT lower(path) FROM f) GROUP BY id)
SELECT o_orderkey AS id, b.path FROM orders LEFT JOIN b ON b.id = o_orderkey
""")
def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, sup = load(spark, sf_dir, "orders"), load(spark, sf_dir, "supplier")
    t = lambda c: c.cast("string")
    key, cust, supp = F.col("o_orderkey"), F.col("o_custkey"), F.col("s_suppkey")
    first = o.select(key.alias("id"), (key % 4).alias("prio"), F.concat(F.lit("p"), t(key % 4), F.lit("/"), t(cust % 50)).alias("path"))
    late = o.select(key.alias("id"), F.lit(9).cast("long").alias("prio"), F.concat(F.lit("late/"), t(cust % 70)).alias("path"))
    files = sup.select(F.concat(F.lit("P"), t(supp % 3), F.lit("/"), t(supp % 40)).alias("path")).union(sup.select(F.concat(F.lit("LATE/"), t(supp)).alias("path")))
    return relations.first_candidate(o.select(key.alias("id")), first.union(late), files)


@query("""
SELECT o_custkey, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1
""")
def exactly_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.only_match(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey")


@query("""
SELECT c_custkey AS key, c_mktsegment AS before, s_name AS after FROM customer JOIN supplier ON s_suppkey = c_custkey
WHERE c_mktsegment <> s_name AND c_custkey % 5 <> 0 AND s_suppkey % 7 <> 0
""")
def context_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 5 == 0, " Unknown").otherwise(F.col("c_mktsegment")).alias("value"))
    after = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 7 == 0, "?").otherwise(F.col("s_name")).alias("value"))
    return relations.context_mismatches(before, after)


@query("""
SELECT l_returnflag || ' | rep' || l_linenumber || ' | ' || l_linestatus || ' | m' || l_suppkey || ':' || CAST(l_quantity AS INT) || ' | a/b c' AS value FROM lineitem
""")
def finding_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq"), F.col("l_returnflag").alias("severity"), F.concat(F.lit("rep"), F.col("l_linenumber").cast("string")).alias("report"), F.col("l_linestatus").alias("section"),
        F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("module"), F.col("l_quantity").cast("int").alias("line"), F.lit("a|b\nc").alias("message"),
    )
    return render.finding_lines(rows)


@query("""
SELECT 'analyzer.' || CASE WHEN l_returnflag = 'R' THEN 'dead-code' ELSE 'read-set' END AS rule_id, CASE WHEN l_linestatus = 'F' THEN 'warning' ELSE 'note' END AS level, 'src/u' || l_suppkey || '.pas' AS uri,
  CAST(l_quantity AS INT) AS line, CASE WHEN l_returnflag = 'R' THEN 'Dead code' ELSE 'Read+Set' END || ': x' || l_linenumber AS message FROM lineitem WHERE l_linenumber <> 2
""")
def sarif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("l_returnflag") == "R", "Dead code").otherwise("Read+Set")
    up = F.when(F.col("l_linenumber") == 2, "..\\..\\out.pas").otherwise(F.concat(F.lit("src\\a\\..\\.\\u"), F.col("l_suppkey").cast("string"), F.lit(".pas")))
    rows = load(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "strong-warning").otherwise("warning").alias("severity"), section.alias("section"), up.alias("path"), F.col("l_quantity").cast("int").alias("line"),
        F.concat(F.lit("x"), F.col("l_linenumber").cast("string")).alias("message"), F.lit(None).cast("string").alias("id"),
    )
    none = spark.createDataFrame([], "code string, path string, file string, line int, col int, message string")
    place = F.get("result.locations", F.lit(0))["physicalLocation"]
    out = render.sarif_results(none, rows)
    return out.select("rule_id", F.col("result.level").alias("level"), place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("line"), F.col("result.message.text").alias("message"))


@query("""
WITH h AS (SELECT CAST(o_orderkey AS VARCHAR) AS ts, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 9 END AS total FROM orders),
d AS (SELECT *, total - last_value(total IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta FROM h)
SELECT '| ' || ts || ' | ' || coalesce(CAST(total AS VARCHAR), '?') || ' | ' || CASE WHEN delta IS NULL THEN '' WHEN delta = 0 THEN '0' ELSE printf('%+d', CAST(delta AS BIGINT)) END || ' |' AS value FROM (SELECT * FROM d ORDER BY ts DESC LIMIT 20)
""")
def trend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(F.lit(1).alias("project"), key, key.cast("string").alias("summary_timestamp"), F.when(key % 3 != 0, F.col("o_custkey") % 9).alias("total"))
    return render.trend_lines(relations.trend(rows, ["total"], "project", "o_orderkey"), ["total"])


@query("""
SELECT count(*) AS total, count(*) FILTER (NOT coalesce(s.s_nationkey = c.c_nationkey, false)) AS to_validate, count(*) FILTER (coalesce(s.s_nationkey = c.c_nationkey, false)) AS skipped
FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey
""")
def form_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("hash"))
    old = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("hash"), F.lit("r").alias("resource"), F.lit("OK").alias("status"))
    return project_state.form_cache_stats(relations.changed_or_unknown(now, old, "c_custkey", ["hash"]))


@query("""
SELECT count(DISTINCT p) AS changed, count(DISTINCT CASE WHEN p LIKE '%.pas' THEN lower(regexp_extract(p, '([^/]+)[.]pas$', 1)) END) AS units
FROM (SELECT CASE WHEN l_linenumber = 1 THEN 'src/U' || (l_suppkey % 30) || '.pas' ELSE 'doc/' || (l_suppkey % 20) || '.txt' END AS p FROM lineitem)
""")
def changed_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    supp = F.col("l_suppkey")
    new = F.when(F.col("l_linenumber") == 1, F.concat(F.lit(' M "src\\U'), (supp % 30).cast("string"), F.lit('.pas"'))).otherwise(F.concat(F.lit("R  old.txt -> ./doc/"), (supp % 20).cast("string"), F.lit(".txt")))
    changed = project_state.changed_files(load(spark, sf_dir, "lineitem").select(new.alias("text")))
    return changed.agg(F.count("*").alias("changed")).crossJoin(project_state.changed_units(changed).agg(F.count("*").alias("units")))


# ---- codes, paths, validator logs, reports ----------------------------------------


@query("""
SELECT o_orderkey, sha256(o_orderpriority) AS content, strftime(CAST(o_orderdate AS DATE), '%Y%m%d') || '000000000' AS stamp,
  ['project', 'contains', 'interface', 'implementation'][CAST(o_custkey % 4 AS INT) + 1] AS kind, CAST(o_custkey % 4 AS INT) AS place, o_orderkey % 5 IN (0, 1, 4) AS enabled,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN o_custkey % 3 WHEN 1 THEN CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 3 ELSE 34 END WHEN 2 THEN 35 WHEN 3 THEN 3 ELSE 1 END AS INT) AS exit_code,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 5 <> 0 THEN 'symbols' END WHEN o_custkey % 3 < 2 THEN 'definition' ELSE 'hover' END AS operation
FROM orders
""")
def code_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    one_of = lambda place, *items: F.get(F.array(*[F.lit(x) for x in items]), place.cast("int"))
    kind = codes.name_of((cust % 4).cast("int"), codes.EDGE_KINDS)
    failure = one_of(key % 5, "none", "buildFailed", "validatorNotFound", "toolNotFound", "something else")
    message = one_of(cust % 3, "Undeclared identifier: x", "UNDECLARED METHOD y", "Type mismatch")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", codes.content_hash(F.col("o_orderpriority")).alias("content"), codes.file_stamp(F.col("o_orderdate").cast("date")).alias("stamp"), kind.alias("kind"),
        codes.ordinal(kind, codes.EDGE_KINDS).alias("place"), codes.truthy(one_of(key % 5, "1", " Yes", "off", "", "ON ")).alias("enabled"),
        codes.exit_code(failure, (cust % 3).cast("int")).alias("exit_code"),
        codes.enrichment_operation(message, F.when(key % 2 == 0, "").otherwise("x"), F.when(cust % 5 == 0, "").otherwise("P")).alias("operation"),
    )


@query(r"""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'C:\src\A.dpr' WHEN 1 THEN 'C:\work\sub\U' || p_partkey WHEN 3 THEN 'D:\b' || p_partkey WHEN 4 THEN 'C:\r\' || p_partkey WHEN 5 THEN '\\srv\share\x' END AS full_path,
  '"a""' || p_name || '"' AS quoted, 'W5' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS rule, 'A;' || upper(p_brand) AS resources
FROM part
""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    k = key.cast("string")
    raw = F.when(key % 6 == 0, F.concat(F.lit(" /mnt/c/src/"), k, F.lit("/../A.dpr"))).when(key % 6 == 1, F.concat(F.lit("sub/./U"), k)).when(key % 6 == 2, "/opt/x")
    raw = raw.when(key % 6 == 3, F.concat(F.lit(r"D:\a\..\..\b"), k)).when(key % 6 == 4, F.concat(F.lit("\\r\\"), k)).otherwise(r"\\srv\share\..\x")
    return load(spark, sf_dir, "part").select(
        "p_partkey", text.absolute_path(raw, "C:/work/").alias("full_path"), text.cmd_quote(F.concat(F.lit('a"'), "p_name")).alias("quoted"),
        text.rule_id_from_line(F.concat(F.lit("  w5"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit(" unused"))).alias("rule"),
        F.array_join(text.requested_resources(F.concat("p_brand", F.lit(".dfm, a;"), "p_brand")), ";").alias("resources"),
    )


@query(r"""
WITH r AS (SELECT p_partkey, p_partkey % 50 AS n, p_partkey % 3 AS k FROM part)
SELECT p_partkey, CASE WHEN s_suppkey IS NULL THEN NULL WHEN k = 0 THEN 'C:\work\p' || n || '.dproj' ELSE 'C:\work\P' || n || '.DPROJ' END AS project,
  CASE WHEN k = 2 THEN 'neither project nor main source' WHEN s_suppkey IS NOT NULL THEN NULL WHEN k = 1 THEN 'file not found' ELSE 'no project beside the main source' END AS problem
FROM r LEFT JOIN supplier ON s_suppkey = n AND k < 2
""")
def project_of_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    n = (key % 50).cast("string")
    path = F.when(key % 3 == 0, F.concat(F.lit("p"), n, F.lit(".dpr"))).when(key % 3 == 1, F.concat(F.lit("/mnt/c/work/P"), n, F.lit(".DPROJ"))).otherwise("x.txt")
    listing = load(spark, sf_dir, "supplier").select(F.concat(F.lit("c:/work/p"), F.col("s_suppkey").cast("string"), F.lit(".dproj")).alias("path"))
    return project_state.project_files(load(spark, sf_dir, "part").select("p_partkey", path.alias("path")), listing, "C:\\work").drop("path")


@query("""
SELECT l_orderkey % 100 AS path, l_orderkey * 10 + l_linenumber AS line_no, CASE l_linenumber % 4 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'CHECK' ELSE 'WARN' END AS kind,
  CASE WHEN l_linenumber % 4 < 2 THEN 'TForm' || l_partkey ELSE 'Main.dfm' END AS resource,
  CASE l_linenumber % 4 WHEN 0 THEN 'no method ''Do' || l_suppkey || ''' (OnClick)' WHEN 3 THEN 'lost property Caption' END AS reason,
  CASE WHEN l_linenumber % 4 = 3 THEN 'Caption' END AS member, CASE WHEN l_linenumber % 4 = 0 THEN 'Do' || l_suppkey END AS method, CASE WHEN l_linenumber % 4 = 0 THEN 'OnClick' END AS event
FROM lineitem WHERE l_linenumber % 4 <> 2
""")
def validator_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, part = F.col("l_linenumber") % 4, F.col("l_partkey").cast("string")
    line = F.when(kind == 0, F.concat(F.lit("FAIL TForm"), part, F.lit(" - no method 'Do"), F.col("l_suppkey").cast("string"), F.lit("' (OnClick)")))
    line = line.when(kind == 1, F.concat(F.lit("CHECK: TForm"), part)).when(kind == 3, "[WARN] Main.dfm: lost property Caption").otherwise("streaming forms")
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), line.alias("text"))
    return build_log.validator_results(rows)


@query("SELECT l_orderkey % 50 AS path, bool_or(l_suppkey % 30 = 3 AND l_linenumber = 1) AS generated FROM lineitem GROUP BY 1")
def generated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("l_linenumber") == 1, ".PAS(7): Error E1").otherwise(".pas compiled")
    line = F.concat(F.lit("Unit"), (F.col("l_suppkey") % 30).cast("string"), state)
    return build_log.is_generated_failure(load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("path"), line.alias("text")), ["unit3.pas"])


@query("""
SELECT c_custkey // 3 AS path, min('b' || c_custkey) AS button, min('a' || c_custkey) AS action FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1 HAVING count(*) = 1
""")
def button_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.expr("c_custkey div 3").alias("path"), F.col("c_custkey").cast("string").alias("k"), (F.col("c_nationkey") % 3 == 0).alias("listed"))
    node = lambda df, name, cls, id_, parent, action: df.select("path", name.alias("name"), F.lit(cls).alias("class"), id_.cast("string").alias("node_id"), parent.alias("parent_id"), F.create_map(F.lit("Action"), action).alias("props"))
    none, forms_ = F.lit(None).cast("string"), c.select("path").distinct()
    out = node(c, F.concat(F.lit("b"), "k"), "TBITBTN", F.concat(F.lit("b"), "k"), F.lit("form"), F.concat(F.lit("a"), "k"))
    out = out.union(node(c, F.concat(F.lit("a"), "k"), "TAction", F.concat(F.lit("a"), "k"), F.when(F.col("listed"), "list").otherwise("form"), none))
    out = out.union(node(forms_, F.lit("form"), "TForm", F.lit("form"), none, none)).union(node(forms_, F.lit("list"), "TActionList", F.lit("list"), F.lit("form"), none))
    return forms.standalone_action_button(out)


@query("""
WITH c AS (SELECT 'W' || (500 + l_suppkey % 15) AS code, count(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT row_number() OVER (ORDER BY n DESC, lower(code)) AS r, * FROM c QUALIFY r <= 10),
h AS (SELECT unnest(generate_series(0, 12)) AS ordinal, unnest(['# Static analysis summary: P', '', '- Timestamp: now', '- Project: `p.dproj`', '- Outputs: `out`', '', '## Lint', '',
  '- Report files: txt=`a.txt`, csv=`a.csv`', '- Exit codes: txt=0, csv=1', '- Note: some outputs are missing (csv).', '- Findings (by code): ' || (SELECT sum(n) FROM c), '- Top codes:']) AS value),
z AS (SELECT 13 + (SELECT count(*) FROM t) + unnest(generate_series(0, 3)) AS ordinal, unnest(['', '## Analyzer', '', '- Skipped.']) AS value)
SELECT * FROM h UNION ALL SELECT 12 + r, '  - ' || code || ': ' || n FROM t UNION ALL SELECT * FROM z
""")
def project_summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = relations.code_counts(load(spark, sf_dir, "lineitem").select(F.concat(F.lit("W"), (F.col("l_suppkey") % 15 + 500).cast("string")).alias("code")))
    runs = spark.createDataFrame([("csv", "a.csv", 1, False), ("txt", "a.txt", 0, True)], "kind string, path string, exit_code int, present boolean")
    none = spark.createDataFrame([], "output_root string, exit_code int, report_root string, version string, compiler string, warnings int, strong_warnings int, exceptions int")
    return markdown.project_summary("P", "p.dproj", "out", "now", runs, counts, none)


@query("""
WITH f AS (SELECT DISTINCT s_suppkey % 5 AS u FROM supplier),
a AS (SELECT l_orderkey * 10 + l_linenumber AS seq, '- [W5] src/U' || u || '.pas:' || l_linenumber || ':? - ' || l_returnflag AS value FROM lineitem JOIN f ON u = l_suppkey % 7),
b AS (SELECT o_orderkey AS seq, '- [' || o_orderpriority || '] u' || u || ':1 - ' AS value FROM orders JOIN f ON u = o_custkey % 7),
h AS (SELECT 0 AS part, unnest(generate_series(0, 4)) AS ordinal, unnest(['# T (changed files)', '', '- Timestamp: now', '- Changed files: ' || (SELECT count(*) FROM f), '']) AS value)
SELECT * FROM h UNION ALL SELECT 1, -1, '## Changed files' UNION ALL SELECT 1, 0, '- `src/U' || u || '.pas`' FROM f UNION ALL SELECT 2, -1, ''
UNION ALL SELECT 3, -2, '## Lint (changed files)' UNION ALL SELECT 3, -1, '- Findings: ' || (SELECT count(*) FROM a) UNION ALL SELECT 4, -1, '' UNION ALL SELECT 3, * FROM (SELECT * FROM a ORDER BY seq, value LIMIT 200)
UNION ALL SELECT 5, -2, '## Analyzer (changed files)' UNION ALL SELECT 5, -1, '- Findings: ' || (SELECT count(*) FROM b) UNION ALL SELECT 6, -1, '' UNION ALL SELECT 5, * FROM (SELECT * FROM b ORDER BY seq, value LIMIT 200)
""")
def changed_files_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = load(spark, sf_dir, "supplier").select(F.concat(F.lit("src/U"), (F.col("s_suppkey") % 5).cast("string"), F.lit(".pas")).alias("path"))
    lint_rows = load(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit("W5").alias("code"), F.concat(F.lit("src/U"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".pas")).alias("path"),
        F.col("l_linenumber").alias("line"), F.lit(None).cast("int").alias("col"), F.col("l_returnflag").alias("message"),
    )
    analyzer = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("section"), F.concat(F.lit(" u"), (F.col("o_custkey") % 7).cast("string")).alias("module"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("message"),
    )
    return markdown.changed_report("T", "now", changed, lint_rows, analyzer)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency edges inside cycles, the best to cut first."""
    return hotspot_pairs(spark, sf_dir)
