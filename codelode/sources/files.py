"""File scans: whole files as rows, lines as rows, and one-row-per-file parsers spread over executors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codelode.session import ship


ANSI = "cp1252"
#: Characters of the ANSI code page where Latin-1 has control characters.
CONTROLS, WESTERN = "".join(map(chr, range(0x80, 0xA0))), bytes(range(0x80, 0xA0)).decode(ANSI, "replace")


def decode(content: bytes) -> str:
    """UTF-8, with or without its mark, else the western code page."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode(ANSI, "replace")


def text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, modified, size, content) of the files below a folder; contents are read only where a query needs them."""
    out = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return out.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, modified, size) without contents."""
    return text_files(spark, root, glob).drop("content")


def file_text(content: Column) -> Column:
    """Contents as text, as :func:`decode` gives it, inside the JVM."""
    western = F.translate(F.decode(content, "ISO-8859-1"), CONTROLS, WESTERN)
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(western)
    return F.regexp_replace(text, "^﻿", "")


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, text), line numbers from 1; line ends of any kind, the last one ends no further line."""
    body = F.regexp_replace(F.regexp_replace(file_text(F.col("content")), r"\r\n?", "\n"), r"\n\z", "")
    return files.select("path", F.posexplode(F.split(body, "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line_no"), "text")


def parse_files(files: DataFrame, parser: Callable[[str, str], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that ``parser(path, text)`` yields for each file, one file in memory at a time; missing fields are null."""
    ship(files.sparkSession)
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [{"path": path, **row} for row in parser(path, decode(content.as_py() or b""))]
                if rows:
                    yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in arrow} for r in rows], schema=arrow)

    return files.select("path", "content").mapInArrow(run, struct)


def first_below(listing_: DataFrame, name: str) -> DataFrame:
    """The folder that directly holds ``name``, of the shallowest hit, then the first in order: one row (folder)."""
    hit = listing_.where(F.lower(F.regexp_extract("path", "([^/]*)$", 1)) == name.lower())
    depth = F.size(F.split("path", "/"))
    return hit.agg(F.min_by(F.regexp_replace("path", "/[^/]*$", ""), F.struct(depth, "path")).alias("folder"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema; blank lines are skipped."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.select(F.from_json("value", schema).alias("x")).select("x.*")


def pattern_list(mask: str) -> list[str]:
    return [x.strip() for x in re.split("[;,]", mask) if x.strip()]
