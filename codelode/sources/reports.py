"""Summary reports, version maps and lint section states read by anchored patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def markdown_fields(files: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per summary (path, text): each field caught by its pattern, anchored to lines; null if it isn't there."""
    at = lambda p: F.nullif(F.regexp_extract("text", f"(?m){p}", 1), F.lit(""))
    return files.select("path", *[at(p).alias(name) for name, p in fields.items()])


def markdown_counts(files: DataFrame, pattern: str = r"^\s*-\s+([A-Z][0-9]{3}):\s+(\d+)\s*$") -> DataFrame:
    """(path, code, n) of list items of a summary."""
    rows = files.select("path", F.explode(F.split("text", "\n")).alias("line"))
    rows = rows.select("path", F.regexp_extract("line", pattern, 1).alias("code"), F.regexp_extract("line", pattern, 2).try_cast("int").alias("n"))
    return rows.where("code <> '' and n is not null")


def version_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, result) of a JSON object from version numbers to texts."""
    text = spark.read.option("wholetext", "true").text(path)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "result"))
    return rows.select(F.col("k").try_cast("int").alias("key"), "result").where("key is not null")


def section_of_line(lines: DataFrame) -> DataFrame:
    """Source lines (path, line_no, text) with the declaration section they are in: the last section word up to them, routine bodies and types end it."""
    word = F.lower(F.regexp_extract("text", r"(?i)^\s*(class\s+var|threadvar|var|const|type|resourcestring|implementation|interface|begin|procedure|function|constructor|destructor)\b", 1))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(word != "", F.regexp_replace(word, r"\s+", " ")), ignorenulls=True).over(w))


def typed_constants(lines: DataFrame) -> DataFrame:
    """(path, line_no, name, type) of ``Name: Type = value`` lines in constant sections."""
    rows = section_of_line(lines).where("section = 'const'")
    pattern = r"(?i)^\s*(?:const\s+)?([A-Za-z_]\w*)\s*:\s*([^=]+?)\s*="
    return rows.where(F.col("text").rlike(pattern)).select("path", "line_no", F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("type"))


def nesting_depth(lines: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """Lines with their depth after them: a running sum of what opens less what closes."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("depth", F.sum(opens.cast("int") - closes.cast("int")).over(w))


def run_context(*sources: DataFrame) -> DataFrame:
    """(key, value): for each key the first source, in order, that knows it; ``unknown`` if none does."""
    rows = None
    for i, source in enumerate(sources):
        part = source.select("key", "value", F.lit(i).alias("o"))
        rows = part if rows is None else rows.union(part)
    known = F.coalesce(F.trim("value"), F.lit("")) != ""
    return rows.groupBy("key").agg(F.coalesce(F.min_by("value", F.when(known, F.col("o"))), F.lit("unknown")).alias("value"))
