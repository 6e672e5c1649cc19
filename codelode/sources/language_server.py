"""Recorded language-server answers: locations, hovers and symbol trees."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL = "path string, name string, kind int, container string, file string, line int, col int"


def file_of_uri(uri: Column) -> Column:
    """The path of a file URI: percent-decoded, plus signs kept, drives and shares with backslashes; other text stays."""
    body = F.url_decode(F.replace(F.regexp_replace(uri, "(?i)^file://", ""), F.lit("+"), F.lit("%2B")))
    drive = F.regexp_replace(F.regexp_replace(body, "^/+(?=[A-Za-z]:)", ""), "/", "\\\\")
    share = F.concat(F.lit("\\\\"), F.translate(body, "/", "\\"))
    path = F.when(body.rlike("^/*[A-Za-z]:"), drive).when(F.startswith(body, F.lit("/")), body).otherwise(share)
    return F.when(F.lower(uri).startswith("file://"), path).otherwise(uri)


LOCATION = "struct<uri:string,targetUri:string,range:struct<start:struct<line:int,character:int>,`end`:struct<line:int,character:int>>,targetSelectionRange:struct<start:struct<line:int,character:int>,`end`:struct<line:int,character:int>>>"


def locations(answers: DataFrame) -> DataFrame:
    """(id, ordinal, file, uri, line, col, end_line, end_col), 1-based, of answers (id, body): one location, an array, or links."""
    body = F.trim("body")
    many = F.when(body.startswith("["), F.from_json("body", f"array<{LOCATION}>")).otherwise(F.array(F.from_json("body", LOCATION)))
    rows = answers.select("id", F.posexplode(many).alias("ordinal", "x")).where("coalesce(x.uri, x.targetUri) is not null")
    r = F.coalesce(F.col("x.range"), F.col("x.targetSelectionRange"))
    uri = F.coalesce("x.uri", "x.targetUri")
    return rows.select(
        "id", "ordinal", file_of_uri(uri).alias("file"), uri.alias("uri"), (r["start"]["line"] + 1).alias("line"), (r["start"]["character"] + 1).alias("col"),
        (r["end"]["line"] + 1).alias("end_line"), (r["end"]["character"] + 1).alias("end_col"),
    )


def hover_text(body: Column) -> Column:
    """Text of a hover: a string, a {value}, or an array of either, joined by line feeds."""
    inner = F.get_json_object(body, "$.contents")
    array = F.from_json(inner, "array<string>")
    parts = F.transform(array, lambda x: F.coalesce(F.get_json_object(x, "$.value"), x))
    return F.when(F.startswith(F.trim(inner), F.lit("[")), F.array_join(F.array_compact(parts), "\n")).otherwise(F.coalesce(F.get_json_object(inner, "$.value"), inner))


def _walk(items: list, container: str, file: str) -> Iterator[dict]:
    for x in items:
        place = (x.get("location") or {}).get("range") or x.get("selectionRange") or x.get("range") or {}
        start = place.get("start") or {}
        owner = x.get("containerName") or container
        yield {"name": x.get("name", ""), "kind": x.get("kind"), "container": owner, "file": (x.get("location") or {}).get("uri") or file, "line": start.get("line", 0) + 1, "col": start.get("character", 0) + 1}
        yield from _walk(x.get("children") or [], x.get("name", ""), file)


def symbol_tree(path: str, text: str) -> Iterator[dict]:
    """Symbols of one recorded answer, nested ones under their container's name."""
    body = json.loads(text)
    items = body.get("result", body) if isinstance(body, dict) else body
    yield from _walk(items or [], "", path)


def sorted_symbols(symbols: DataFrame, query: str = "", limit: int = 50) -> DataFrame:
    """By file, place, name, kind and container; filtered by a part of the name, then limited (0 or less: all)."""
    out = symbols.where(F.contains(F.lower("name"), F.lit(query.lower()))) if query else symbols
    out = out.orderBy("file", "line", "col", "name", "kind", "container")
    return out.limit(limit) if limit > 0 else out
