"""Caches, file state, lookups by version and guidance for failed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from codelode.functions.codes import file_stamp
from codelode.functions.text import absolute_path, contains_flag, resource_key, resource_token, slashes
from codelode.operators.relations import small

PARTS = ("files", "symbols", "refs", "ambiguities")


# ---- result cache ------------------------------------------------------------------


def file_state(listing: DataFrame) -> DataFrame:
    """(path, stamp, size) that a cached result is valid for."""
    return listing.select("path", file_stamp(F.col("modified")).alias("stamp"), "size")


def input_hash(state: DataFrame) -> DataFrame:
    """One row (hash): SHA-256 over all files' sorted state; equal states have equal hashes."""
    line = F.sha2(F.concat_ws("|", F.lower("path"), "stamp", F.col("size").cast("string")), 256)
    # sums of digest halves don't depend on order, so no task sees all files
    half = lambda a: F.sum(F.conv(F.substring(line, a, 12), 16, 10).cast("decimal(38,0)"))
    return state.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[half(a).cast("string") for a in (1, 13, 25, 37)]), 256).alias("hash"))


def write_cache(root: str, files: DataFrame, symbols: DataFrame, refs: DataFrame, ambiguities: DataFrame) -> None:
    """Replace the cached tables; the file state goes last, so a broken write is never taken for a cache."""
    spark = files.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/files")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    for name, df in (("symbols", symbols), ("refs", refs), ("ambiguities", ambiguities), ("files", files)):
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def read_cache(spark: SparkSession, root: str, current: DataFrame) -> dict[str, DataFrame] | None:
    """The cached tables, ordered as they are listed, or None if files changed, went or came since."""
    try:
        tables = {name: spark.read.parquet(f"{root}/{name}") for name in PARTS}
    except AnalysisException:
        return None
    old, keys = tables["files"], ["path", "stamp", "size"]
    if not old.join(current, keys, "left_anti").isEmpty() or not current.join(old, keys, "left_anti").isEmpty():
        return None
    tables["symbols"] = tables["symbols"].orderBy("symbol_id")
    tables["refs"] = tables["refs"].join(tables["symbols"].select("symbol_id"), "symbol_id").orderBy("symbol_id", "line", "col")
    tables["ambiguities"] = tables["ambiguities"].orderBy("file", "line", "col")
    return tables


def form_cache(current: DataFrame, previous: DataFrame, results: DataFrame) -> DataFrame:
    """The new form cache (unit, hash, resource, status): results where there are some, else what was known; units not current go."""
    old = previous.select("unit", F.col("resource").alias("_r"), F.col("status").alias("_s"))
    new = results.select("unit", "resource", "status")
    out = current.select("unit", "hash").join(new, "unit", "left").join(old, "unit", "left")
    return out.select("unit", "hash", F.coalesce("resource", "_r").alias("resource"), F.coalesce("status", "_s").alias("status"))


def form_cache_stats(selected: DataFrame) -> DataFrame:
    """One row: total, to_validate, skipped of rows with needs_work."""
    return selected.agg(F.count("*").alias("total"), F.count_if("needs_work").alias("to_validate"), F.count_if(~F.col("needs_work")).alias("skipped"))


# ---- files ---------------------------------------------------------------------------


def changed_files(lines: DataFrame) -> DataFrame:
    """Paths (path) of a version-control status in short form (text): of a rename the new name; quotes and dot prefixes go."""
    body = F.substr("text", F.lit(4))
    path = F.when(F.contains(body, F.lit(" -> ")), F.regexp_extract(body, r" -> (.*)$", 1)).otherwise(body)
    path = F.regexp_replace(F.translate(F.trim(F.translate(path, '"', "")), "\\", "/"), r"^\./", "")
    return lines.where(F.length("text") > 3).select(path.alias("path")).where("path <> ''").distinct()


def changed_units(changed: DataFrame) -> DataFrame:
    """(unit) stems of changed source files."""
    return changed.where(F.lower("path").endswith(".pas")).select(F.lower(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)).alias("unit")).distinct()


def existing_paths(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows (path, ...) whose file or folder is there, compared case-insensitive."""
    there = listing.select(F.lower("path").alias("_p")).union(listing.select(F.lower(F.regexp_replace("path", "/[^/]*$", "")).alias("_p"))).distinct()
    return paths.join(there, F.lower("path") == F.col("_p"), "left_semi")


def project_files(requests: DataFrame, listing: DataFrame, folder: str) -> DataFrame:
    """Requests (path, ...) with the project file meant (project), or why there is none (problem).

    A project file stands for itself, a main source for the project beside it; ``listing`` (path) says what exists.
    """
    full = absolute_path(F.col("path"), folder)
    suffix = F.lower(F.regexp_extract(full, r"(\.[^.\\]*)$", 1))
    wanted = F.when(suffix == ".dproj", full).when(suffix.isin(".dpr", ".dpk"), F.regexp_replace(full, r"\.[^.\\]*$", ".dproj"))
    there = listing.select(F.lower(slashes(F.col("path"))).alias("_p")).distinct()
    out = requests.withColumns({"_full": full, "_suffix": suffix, "_wanted": wanted}).join(there, F.lower("_wanted") == F.col("_p"), "left")
    problem = F.when(F.col("_full").isNull(), "no drive in path").when(F.col("_wanted").isNull(), "neither project nor main source")
    problem = problem.when(F.col("_p").isNull(), F.when(F.col("_suffix") == ".dproj", "file not found").otherwise("no project beside the main source"))
    return out.withColumn("project", F.when(F.col("_p").isNotNull(), F.col("_wanted"))).withColumn("problem", problem).drop("_full", "_suffix", "_wanted", "_p")


def has_enough_markers(markers: list[Column], least: int = 2) -> Column:
    """Whether at least ``least`` of the markers hold."""
    total = F.lit(0)
    for marker in markers:
        total = total + F.coalesce(marker.cast("int"), F.lit(0))
    return total >= least


def without_ignored(diagnostics: DataFrame, names: list[str], masks: Column) -> DataFrame:
    """Diagnostics (kind, value) without unknown macros that are named and missing paths that match."""
    macro = (F.col("kind") == "macro") & F.lower("value").isin([x.lower() for x in names])
    return diagnostics.where(~(macro | ((F.col("kind") == "path") & masks)))


# ---- versions ------------------------------------------------------------------------


def flag_for_version(help_text: str, flags: list[tuple[int, str]], wanted: int) -> Column:
    """The flag of the greatest version not above ``wanted`` that a help text (a column's name) offers; null for none."""
    out = F.lit(None).cast("string")
    for version, flag in sorted(flags):
        if version <= wanted:
            out = F.when(contains_flag(F.col(help_text), flag), flag).otherwise(out)
    return out


# ---- forms ---------------------------------------------------------------------------


def requested_forms(modules: DataFrame, wanted: list[str]) -> DataFrame:
    """Modules (resource, ...) that were asked for, by name with or without the type prefix; none asked for is all."""
    if not wanted:
        return modules
    ask = modules.sparkSession.createDataFrame([(x,) for x in wanted], "name string").select(resource_key(F.col("name")).alias("_k")).distinct()
    return modules.join(F.broadcast(ask), resource_key(F.col("resource")) == F.col("_k"), "left_semi")


def module_of_resource(results: DataFrame, modules: DataFrame) -> DataFrame:
    """Results (resource, ...) with unit and file of their first module (ordinal, resource, unit, file)."""
    key = modules.select(resource_key(F.col("resource")).alias("_k"), "ordinal", "unit", "file")
    first = key.groupBy("_k").agg(F.min_by(F.struct("unit", "file"), "ordinal").alias("_m"))
    return results.join(small(first), resource_key(F.col("resource")) == F.col("_k"), "left").select(results["*"], "_m.unit", "_m.file")


def class_aliases(requested: DataFrame, modules: DataFrame) -> DataFrame:
    """Requested names (name) as root class names where a unit of that stem has one."""
    roots = modules.groupBy(F.lower("unit").alias("_u")).agg(F.min("root_class").alias("_c"))
    return requested.join(small(roots), F.lower("name") == F.col("_u"), "left").select(F.coalesce("_c", "name").alias("name"))


def handler_declaration(handlers: DataFrame, lines: DataFrame) -> DataFrame:
    """Handlers (file, class, method) with the line of their declaration: the qualified one first, else the first unqualified."""
    pattern = r"(?i)^\s*(?:class\s+)?(?:procedure|function)\s+([\w.]+)"
    found = lines.select("file", "line_no", F.lower(F.regexp_extract("text", pattern, 1)).alias("_n")).where("_n <> ''")
    key = ["file", "class", "method"]
    wanted = handlers.select(*key).distinct()
    names = F.array(F.struct(F.lit(0).alias("r"), F.lower(F.concat_ws(".", "class", "method")).alias("n")), F.struct(F.lit(1).alias("r"), F.lower("method").alias("n")))
    spelled = wanted.select(*key, F.inline(names)).withColumnRenamed("n", "_n")
    best = spelled.join(found, ["file", "_n"]).groupBy(*key).agg(F.min(F.struct("r", "line_no"))["line_no"].alias("declaration_line"))
    h, d = handlers.alias("h"), best.alias("d")
    same = F.col("h.file").eqNullSafe(F.col("d.file")) & F.col("h.class").eqNullSafe(F.col("d.class")) & F.col("h.method").eqNullSafe(F.col("d.method"))
    return h.join(d, same, "left").select("h.*", "d.declaration_line")


def failure_guidance(failures: DataFrame, modules: DataFrame, lines: DataFrame) -> DataFrame:
    """Failed resources (resource, class, member, method, event, reason) with one line of advice each."""
    placed = handler_declaration(module_of_resource(failures, modules), lines)
    where = F.when(F.col("declaration_line").isNotNull(), F.concat(F.lit(" declared at "), "file", F.lit(":"), F.col("declaration_line").cast("string")))
    parts = F.concat_ws(
        "", resource_token(F.col("resource")), F.concat(F.lit(" in "), "unit"), F.concat(F.lit(": "), "reason"), F.concat(F.lit(" (member "), "member", F.lit(")")),
        F.concat(F.lit(" (handler "), "method", F.lit(")")), where,
    )
    return placed.withColumn("guidance", parts)


def promoted_warnings(warnings: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """Warnings (path, ...) of forms where the diagnosis gave exactly one result; these count as failures."""
    once = diagnosed.groupBy("path").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return warnings.join(once, "path").join(diagnosed, "path")


def first_sorted(files: DataFrame, key: str = "folder") -> DataFrame:
    """(key, path): the first file of each folder in order."""
    return files.groupBy(key).agg(F.min("path").alias("path"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
