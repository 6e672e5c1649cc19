"""Build and validator logs as findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.text import compiler_location, excluded_log_line, strip_root


def classify(line: Column) -> Column:
    """error, warning or hint of one log line, or null; the first rule that fits counts."""
    return (
        F.when(line.rlike(r":\s+(?:error|fatal)\s+"), "error")
        .when(line.rlike(r"(?:^|\s)(?:\[Fatal Error\]|\[Error\]|Fatal Error:|Error:)"), "error")
        .when(line.rlike(r":\s+warning\s+W\d+:"), "warning")
        .when(line.rlike(r"(?:^|\s)(?:\[Warning\]|Warning:)"), "warning")
        .when(line.rlike(r" hint warning\s+H\d+:|:\s+hint\s+H\d+:"), "hint")
        .when(line.rlike(r"(?:^|\s)(?:\[Hint\]|Hint:)"), "hint")
    )


def log_code(line: Column) -> Column:
    """The code of a coded warning or hint, upper-cased, or null."""
    code = F.regexp_extract(line, r":\s+warning\s+(W\d+):| hint warning\s+(H\d+):|:\s+hint\s+(H\d+):", 0)
    return F.nullif(F.upper(F.regexp_extract(code, r"([WH]\d+):$", 1)), F.lit(""))


def findings(lines: DataFrame, root: str = "", ignore: list[str] = (), masks: list[str] = ()) -> DataFrame:
    """Log lines (stream, line_no, raw) that report something: (stream, line_no, class, code, file, line, col, display, raw).

    ``display`` has no project root; lines of masked files and ignored codes go.
    """
    shown = strip_root(F.col("raw"), root) if root else F.col("raw")
    rows = lines.withColumn("display", shown)
    if masks:
        rows = rows.where(~excluded_log_line(F.col("display"), list(masks)))
    rows = rows.withColumn("class", classify(F.col("display"))).where("class is not null").withColumn("code", F.when(F.col("class") != "error", log_code(F.col("display"))))
    if ignore:
        rows = rows.where(~F.coalesce(F.col("code").isin([x.upper() for x in ignore]), F.lit(False)))
    at = compiler_location(F.col("display"))
    return rows.select(
        "stream", "line_no", "class", "code", at["file"].alias("file"), at["line"].alias("line"), at["col"].alias("col"), F.trim("display").alias("display"), F.trim("raw").alias("raw")
    )


def counts(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, hints; caps on the listing don't change them."""
    one = lambda c: F.count_if(F.col("class") == c)
    return found.agg(one("error").alias("errors"), one("warning").alias("warnings"), one("hint").alias("hints"))


def listed(found: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` findings of each class, the error stream's first, then the output's; 0 or less is no cap."""
    order = [F.when(F.col("stream") == "err", 0).otherwise(1), "line_no"]
    out = found.withColumn("ordinal", F.row_number().over(Window.partitionBy("class").orderBy(*order)))
    return out.where(F.col("ordinal") <= cap) if cap > 0 else out


def validator_results(lines: DataFrame) -> DataFrame:
    """FAIL, WARN and CHECK lines of a validator log: (path, line_no, kind, resource, reason, member, method, event)."""
    kind = F.regexp_extract("text", r"^\s*\[?(FAIL|WARN|CHECK)\]?[:\s]", 1)
    part = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    out = lines.withColumn("kind", kind).where("kind <> ''")
    return out.select(
        "path", "line_no", "kind", part(r"^\s*\[?(?:FAIL|WARN|CHECK)\]?[:\s]+([A-Za-z_][\w.]*)").alias("resource"), part(r"(?:FAIL|WARN)\]?[:\s]+\S+\s*[-:]+\s*(.*)$").alias("reason"),
        part(r"(?i)property ([A-Za-z_][\w.]*)").alias("member"), part(r"(?i)method '?([A-Za-z_]\w*)'?").alias("method"), part(r"\b(On[A-Z]\w*)\b").alias("event"),
    )


def validator_summary(lines: DataFrame) -> DataFrame:
    """(path, summary): the last summary line of each log."""
    rows = lines.where(F.col("text").rlike(r"(?i)^\s*summary\b"))
    return rows.groupBy("path").agg(F.max_by("text", "line_no").alias("summary"))


def last_match(lines: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """(path, value): what the pattern caught in its last matching line."""
    rows = lines.where(F.col("text").rlike(pattern))
    return rows.groupBy("path").agg(F.max_by(F.regexp_extract("text", pattern, group), "line_no").alias("value"))


def is_generated_failure(lines: DataFrame, units: list[str]) -> DataFrame:
    """(path, generated): whether some line names a generated unit and reports an error."""
    names = F.lit(False)
    for unit in units:
        names = names | F.contains(F.lower("text"), F.lit(unit.lower()))
    return lines.groupBy("path").agg(F.max(names & F.lower("text").rlike(r"error|fatal")).alias("generated"))
