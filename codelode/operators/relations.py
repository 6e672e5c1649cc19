"""Joins, filters, set operations and order-dependent operators over findings, symbols and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from codelode.functions.codes import analyzer_priority, fingerprint, lint_priority
from codelode.functions.text import matches_pattern, module_key
from codelode.session import broadcast_if_small, materialize

#: Dimension rows that may be broadcast; larger ones shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the side's size, counted, is within bounds."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


# ---- symbols and references ---------------------------------------------------


def without_locals(usages: DataFrame, routine_locals: DataFrame) -> DataFrame:
    """Usages (routine_id, name, ...) of names that their routine doesn't declare itself."""
    shadow = routine_locals.select("routine_id", F.lower("name").alias("_key"))
    return usages.withColumn("_key", F.lower("name")).join(shadow, ["routine_id", "_key"], "left_anti").drop("_key")


def _visible(usages: DataFrame, symbols: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each distinct (_unit, _key) of the usages (unit and name, lower-cased) what their unit sees of that name, its own or of a unit it uses:
    (_n, symbol_id) how many symbols and the smallest, written; (_text, _all) their sorted qualified names.

    Two equi-joins, on the name and on (unit, seen unit), of distinct keys only: neither usages nor
    symbols of one unit and name multiply each other.
    """
    wanted = usages.select(F.lower("unit").alias("_unit"), F.lower("name").alias("_key")).distinct()
    own = wanted.select("_unit", F.col("_unit").alias("_seen"))
    seen = uses.select(F.lower("unit").alias("_unit"), F.lower("used").alias("_seen")).union(own).distinct()
    declared = symbols.groupBy(F.lower("unit").alias("_seen"), F.lower("name").alias("_key"))

    def joined(*facts: Column) -> GroupedData:
        return wanted.join(declared.agg(*facts), "_key").join(seen, ["_unit", "_seen"]).groupBy("_unit", "_key")

    counts = joined(F.count("*").alias("_n"), F.min("symbol_id").alias("symbol_id")).agg(F.sum("_n").alias("_n"), F.min("symbol_id").alias("symbol_id"))
    names = joined(F.collect_list(F.concat_ws(".", "unit", "name")).alias("_all")).agg(F.array_sort(F.flatten(F.collect_list("_all"))).alias("_all"))
    return materialize(counts, "visible"), names.select("_unit", "_key", F.array_join("_all", "; ").alias("_text"), "_all")


def resolve_usages(usages: DataFrame, symbols: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, ambiguities) of usages (usage_id, unit, name, ...): one visible candidate of a usage_id is a reference, more are an ambiguity, none drops the usage.

    Candidates are counted for each distinct unit and name, so no row is made for a usage and a candidate.
    A usage with one candidate of its own is ambiguous if another row has its usage_id and a candidate.
    """
    counts, names = _visible(usages, symbols, uses)
    keys = usages.columns
    keyed = usages.withColumns({"_unit": F.lower("unit"), "_key": F.lower("name")})
    found = keyed.join(broadcast_if_small(counts), ["_unit", "_key"])
    # only rows with one candidate carry their columns to the others of their usage_id
    lean = found.select(F.col("usage_id").alias("_id"), "_n", F.when(F.col("_n") == 1, F.struct(*keys, "_unit", "_key", "symbol_id")).alias("_row"))
    single = lean.withColumn("_n", F.sum("_n").over(Window.partitionBy("_id"))).where("_row is not null")
    refs = single.where("_n = 1").select("_row.*").select(*keys, "symbol_id")
    several = found.where("_n > 1").select(*keys, "_unit", "_key").union(single.where("_n > 1").select("_row.*").select(*keys, "_unit", "_key"))
    # a row that repeats as a whole has each candidate as often; its repetitions meet where the names are joined
    several = several.repartition("_unit", "_key").groupBy(*keys, "_unit", "_key").agg(F.count("*").cast("int").alias("_c"))
    repeated = F.array_join(F.flatten(F.transform("_all", lambda x: F.array_repeat(x, F.col("_c")))), "; ")
    ambiguous = several.join(names, ["_unit", "_key"]).select(*keys, F.when(F.col("_c") == 1, F.col("_text")).otherwise(repeated).alias("candidates"))
    return refs, ambiguous


def access_matches(access: Column, wanted: str) -> Column:
    """reads takes read and readwrite, writes takes write and readwrite, all takes everything."""
    return {"reads": access.isin("read", "readwrite"), "writes": access.isin("write", "readwrite")}.get(wanted, F.lit(True))


def filter_symbols(symbols: DataFrame, refs: DataFrame, unit: str = "", name: str = "", access: str = "all", unused: bool = False) -> DataFrame:
    """Symbols whose unit and name match and that are unused, or have a reference of the access; unused excludes an access."""
    if unused and access != "all":
        raise ValueError("unused excludes reads and writes")
    out = symbols.where(matches_pattern(F.col("unit"), unit) & matches_pattern(F.col("name"), name))
    ids = refs.select("symbol_id", "access")
    if unused:
        return out.join(ids.select("symbol_id"), "symbol_id", "left_anti")
    if access == "all":
        return out
    return out.join(ids.where(access_matches(F.col("access"), access)).select("symbol_id"), "symbol_id", "left_semi")


def with_references(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Symbols with all their references as an ordered array, not only those a filter matched."""
    fields = [c for c in refs.columns if c != "symbol_id"]
    order = [c for c in ("file", "line", "col") if c in fields]
    used = refs.groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order]))).alias("used_by"))
    return symbols.join(used, "symbol_id", "left")


def symbol_summary(symbols: DataFrame, refs: DataFrame, emitted: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """One row: total, used, unused over all symbols; emitted after filters; ambiguities."""
    used = symbols.join(refs.select("symbol_id").distinct().withColumn("u", F.lit(1)), "symbol_id", "left")
    out = used.agg(F.count("*").alias("total"), F.count("u").alias("used"), F.count_if(F.col("u").isNull()).alias("unused"))
    return out.crossJoin(emitted.agg(F.count("*").alias("emitted"))).crossJoin(ambiguities.agg(F.count("*").alias("ambiguities")))


# ---- files and paths ----------------------------------------------------------


def shortest_path_index(files: DataFrame) -> DataFrame:
    """(stem, path): of files with one stem, case-insensitive, the shortest path, then the first in order."""
    return files.groupBy(F.lower("stem").alias("stem")).agg(F.min(F.struct(F.length("path"), "path")).alias("p")).select("stem", "p.path")


def with_module_path(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings (module, ...) with the path of their module's file, null if there is none."""
    index = shortest_path_index(files).toDF("_stem", "path")
    return findings.join(small(index), module_key(F.col("module")) == F.col("_stem"), "left").drop("_stem")


def unique_basename_index(files: DataFrame) -> DataFrame:
    """(base, path) of file names that occur once, case-insensitive."""
    base = F.lower(F.regexp_extract(F.translate("path", "\\", "/"), "([^/]*)$", 1))
    return files.groupBy(base.alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("base", "path")


def with_repo_path(rows: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` becomes the repository path of its unique base name, or stays."""
    index = unique_basename_index(files).toDF("_base", "_path")
    base = F.lower(F.regexp_extract(F.translate(column, "\\", "/"), "([^/]*)$", 1))
    return rows.join(small(index), base == F.col("_base"), "left").withColumn(column, F.coalesce("_path", column)).drop("_base", "_path")


def only_changed(findings: DataFrame, changed: DataFrame, on: str = "path") -> DataFrame:
    """Findings on changed paths."""
    return findings.join(changed.select(F.col("path").alias(on)).distinct(), on, "left_semi")


def first_candidate(requests: DataFrame, candidates_: DataFrame, files: DataFrame) -> DataFrame:
    """Requests (id) with the existing candidate path (id, prio, path) of lowest priority number."""
    there = candidates_.join(files.select(F.lower("path").alias("_p")).distinct(), F.lower("path") == F.col("_p"), "left_semi")
    best = there.groupBy("id").agg(F.min_by("path", "prio").alias("path"))
    return requests.join(best, "id", "left")


# ---- findings -----------------------------------------------------------------


def distinct_findings(findings: DataFrame, fields: list[str], order: str = "seq") -> DataFrame:
    """The first finding of each case-insensitive key over ``fields``; rows without a module go and empty messages become a dash."""
    rows = findings.where(F.trim(F.coalesce("module", F.lit(""))) != "").withColumn("message", F.coalesce(F.nullif(F.trim("message"), F.lit("")), F.lit("-")))
    key = F.array(*[F.upper(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
    every = F.struct(*rows.columns)
    return rows.groupBy(key.alias("_key")).agg(F.min_by(every, order).alias("_row")).select("_row.*")


def code_counts(findings: DataFrame, code: str = "code") -> DataFrame:
    """(code, n) by upper-cased rule id; ids that aren't a letter and three digits don't count."""
    up = F.upper(F.trim(code))
    return findings.where(up.rlike("^[A-Z][0-9]{3}")).groupBy(F.left(up, F.lit(4)).alias("code")).agg(F.count("*").alias("n"))


def top_codes(counts: DataFrame, k: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("n"), F.lower("code")).limit(k)


def top_sections(findings: DataFrame, severity: str, k: int = 10) -> DataFrame:
    """(section, n) of a severity, most first; ties in order of first sight (seq). Empty sections don't count."""
    rows = findings.where((F.col("severity") == severity) & (F.trim("section") != ""))
    out = rows.groupBy(F.trim("section").alias("section")).agg(F.count("*").alias("n"), F.min("seq").alias("_s"))
    return out.orderBy(F.desc("n"), "_s").limit(k).drop("_s")


def section_totals(sections: DataFrame) -> DataFrame:
    """(report, total): sums of section counts; counts that aren't integers are 0, negative ones count as they are."""
    return sections.groupBy("report").agg(F.sum(F.coalesce(F.col("count").try_cast("int"), F.lit(0))).alias("total"))


def top_hotspots(entries: DataFrame, k: int = 20) -> DataFrame:
    """Complexity entries (name, dp, loc, is_routine, is_aggregate) with dp > 0: the ``k`` highest of each class; sums of modules go."""
    rows = entries.where("dp > 0 and (is_routine or not is_aggregate)")
    w = Window.partitionBy("is_routine").orderBy(F.desc("dp"), F.lower("name"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lint_fingerprint(path: str = "path") -> Column:
    return fingerprint(F.col("code"), F.coalesce(F.nullif(F.col(path), F.lit("")), F.col("file")), F.col("line"), F.col("col"), F.col("message"))


def analyzer_fingerprint() -> Column:
    return fingerprint(*[F.col(c) for c in ("severity", "report", "section", "module", "line", "message", "id", "kind")])


def new_items(current: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows of ``current`` whose key ``baseline`` hasn't."""
    return current.join(baseline.select(key).distinct(), key, "left_anti")


def count_delta(before: DataFrame, after: DataFrame, key: str, n: str = "n", k: int | None = 10) -> DataFrame:
    """(key, before, after, delta) where counts differ, largest change first; ties by key. All rows if ``k`` is None."""
    b, a = before.select(key, F.col(n).alias("before")), after.select(key, F.col(n).alias("after"))
    out = b.join(a, key, "full_outer").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    out = out.withColumn("delta", F.col("after") - F.col("before")).where("delta <> 0").orderBy(F.desc(F.abs("delta")), key)
    return out if k is None else out.limit(k)


def context_mismatches(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, before, after) of run-context entries (key, value) that differ; empty and unknown sides are ignored."""
    def known(df: DataFrame, name: str) -> DataFrame:
        value = F.trim(F.coalesce("value", F.lit("")))
        return df.select("key", value.alias(name)).where(~F.lower(name).isin("", "unknown", "?"))

    return known(before, "before").join(known(after, "after"), "key").where("before <> after")


def gate_reasons(
    new_strong: int | None = 0, new_lint_w: int | None = 0, warning_increase: int | None = None, lint_increase: int | None = None, context: bool = False
) -> Column:
    """Why a delta (new_strong, new_lint_w, warnings_delta, total_delta, mismatches) fails, as an array; a limit of None is off."""
    reasons = []
    if context:
        reasons.append(F.transform(F.coalesce("mismatches", F.array().cast("array<string>")), lambda m: F.concat(F.lit("Context mismatch: "), m)))
    for column, limit, label in (
        ("new_strong", new_strong, "New strong warnings"), ("new_lint_w", new_lint_w, "New lint W findings"),
        ("warnings_delta", warning_increase, "Warnings increase"), ("total_delta", lint_increase, "Lint findings increase"),
    ):
        if limit is not None:
            text = F.concat(F.lit(f"{label}: "), F.col(column).cast("string"), F.lit(f" > {limit}"))
            reasons.append(F.array_compact(F.array(F.when(F.coalesce(column, F.lit(0)) > limit, text))))
    return F.concat(*reasons) if reasons else F.array().cast("array<string>")


def gate(delta: DataFrame, **limits: int | bool | None) -> DataFrame:
    """(ok, reasons) of each delta row under the limits of :func:`gate_reasons`."""
    reasons = gate_reasons(**limits)
    return delta.select((F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"))


def triage(lint: DataFrame, analyzer: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` findings to look at first: priority, then code or severity, path and line."""
    a = lint.select(F.lit("lint").alias("tool"), lint_priority(F.left("code", F.lit(1))).alias("priority"), F.col("code").alias("label"), "path", F.col("line").cast("int").alias("line"), "message")
    b = analyzer.select(
        F.lit("analyzer").alias("tool"), analyzer_priority(F.col("severity"), F.col("section"), F.col("message")).alias("priority"),
        F.col("severity").alias("label"), F.coalesce("path", "module").alias("path"), F.col("line").cast("int").alias("line"), "message",
    )
    return a.union(b).orderBy(F.desc("priority"), "label", "path", "line", "message", "tool").limit(k)


def grouped_for_display(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key with its findings as an array ordered by line and message."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "message"))).alias("items"))


# ---- keyed lookups ------------------------------------------------------------


def overlay(rows: DataFrame, key: str = "name", value: str = "value", order: str = "seq", source: str = "source") -> DataFrame:
    """Last writer wins: (key, value, source) of the highest ``order``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(value, source), order).alias("x")).select(key, "x.*")


def settings_cascade(rows: DataFrame, list_keys: list[str]) -> DataFrame:
    """(key, value) from (precedence, key, value): scalars take the highest precedence, lists join, first spelling of each item, in precedence order."""
    scalars = rows.where(~F.col("key").isin(list_keys)).groupBy("key").agg(F.max_by("value", "precedence").alias("value"))
    items = rows.where(F.col("key").isin(list_keys)).select("key", "precedence", F.posexplode(F.split("value", ";")).alias("pos", "item"))
    items = items.withColumn("item", F.trim("item")).where("item <> ''")
    first = items.groupBy("key", F.lower("item").alias("k")).agg(F.min(F.struct("precedence", "pos", "item")).alias("x"))
    lists = first.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]), ";").alias("value"))
    return scalars.union(lists)


def as_of(values: DataFrame, table: DataFrame, value: str = "major", key: str = "key", result: str = "result") -> DataFrame:
    """Each row's ``result`` at the greatest ``key`` not above its ``value``; null if all are above.

    The table is a dimension of versions, some hundreds of rows at most: it becomes one sorted
    array that is sent to every task and searched per row, so no range join is formed.
    """
    left = values.withColumn("_at", F.col(value)).withColumn("_side", F.lit(1)).withColumn("_result", F.lit(None).cast(table.schema[result].dataType))
    steps = table.groupBy(F.col(key).alias("_at")).agg(F.max(result).alias("_result")).orderBy("_at")
    ladder = steps.agg(F.array_sort(F.collect_list(F.struct("_at", "_result"))).alias("_steps"))
    best = F.element_at(F.filter("_steps", lambda s: s["_at"] <= F.col(value)), -1)
    out = left.drop("_at", "_side", "_result").crossJoin(F.broadcast(ladder))  # one row: the version table as an array
    return out.withColumn(result, F.when(F.exists("_steps", lambda s: s["_at"] <= F.col(value)), best["_result"])).drop("_steps")


def lines_around(findings: DataFrame, lines: DataFrame, radius: int = 2) -> DataFrame:
    """Findings (finding_id, file, line) with the source lines (file, line_no, text) within ``radius``: an equi-join on each wanted line."""
    want = findings.select("finding_id", "file", F.explode(F.sequence(F.greatest(F.col("line") - radius, F.lit(1)), F.col("line") + radius)).alias("line_no"), "line")
    return want.join(lines, ["file", "line_no"]).withColumn("is_target", F.col("line_no") == F.col("line"))


def changed_or_unknown(current: DataFrame, cache: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """Current rows with needs_work: false only if the cache has the key with equal hashes, a resource and status OK."""
    old = cache.select(key, *[F.col(h).alias(f"_{h}") for h in hashes], F.col("resource").alias("_resource"), F.col("status").alias("_status"))
    same = F.lit(True)
    for h in hashes:
        same = same & F.col(h).eqNullSafe(F.col(f"_{h}"))
    known = F.coalesce(same & (F.coalesce("_resource", F.lit("")) != "") & (F.upper("_status") == "OK"), F.lit(False))
    return current.join(old, key, "left").withColumn("needs_work", ~known).drop(*[f"_{h}" for h in hashes], "_resource", "_status")


def only_match(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that are the only one of their keys."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


# ---- order-dependent ----------------------------------------------------------


def carry_forward(rows: DataFrame, value: Column, name: str, partition: str, order: str) -> DataFrame:
    """``name`` is the last non-null ``value`` up to each row."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def trend(history: DataFrame, metrics: list[str], partition: str, order: str) -> DataFrame:
    """Each metric's change since the last run that had it; null if either side is missing."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumns({f"{m}_delta": F.col(m) - F.last(m, ignorenulls=True).over(w) for m in metrics})


def last_entries(history: DataFrame, partition: str, order: str, k: int = 200) -> DataFrame:
    """The newest ``k`` entries, oldest first in order; an entry with its predecessor's timestamp goes."""
    w = Window.partitionBy(partition)
    rows = history.withColumn("_before", F.lag("summary_timestamp").over(w.orderBy(order))).where("_before is null or _before <> summary_timestamp")
    return rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("_r") <= k).drop("_before", "_r")


def within_budget(rows: DataFrame, size: str, order: list[str], budget: int, partition: str) -> DataFrame:
    """Rows in order until the first that would overflow the running sum; none after it."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def enclosing(targets: DataFrame, headers: DataFrame) -> DataFrame:
    """Targets (file, line) with the name of the nearest header (file, line, name) at or above."""
    t = targets.select("*", F.lit(None).cast("string").alias("_name"), F.lit(1).alias("_side"))
    h = headers.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("file", "line") else F.col(f.name) for f in targets.schema], F.col("name").alias("_name"), F.lit(0).alias("_side"))
    w = Window.partitionBy("file").orderBy("line", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return t.union(h).withColumn("enclosing", F.last("_name", ignorenulls=True).over(w)).where("_side = 1").drop("_name", "_side")


def ordered_union(*parts: DataFrame) -> DataFrame:
    """Union of all rows with the ordinal of their source."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("source_ordinal", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def capped(findings: DataFrame, partition: str, order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` findings of each class, in order; 0 or less is no cap."""
    if cap <= 0:
        return findings
    return findings.withColumn("_r", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")
