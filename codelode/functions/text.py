"""Scalar functions over names, paths, locations and lint lines, as Column expressions."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved words, framework prefixes and report codes of the analysed language.
PASCAL_KEYWORDS = (
    "begin class const constructor destructor do else end except finally for function implementation interface operator procedure record then try"
).split()
FRAMEWORK_PREFIXES = "System. Winapi. Vcl. FMX. Xml. Data. Soap. Web. Datasnap. Macapi. Posix.".split()
SOURCE_SUFFIXES = (".pas", ".dpr", ".dpk")


def slashes(path: Column) -> Column:
    """Forward slashes become backslashes."""
    return F.translate(path, "/", "\\")


def mask_regex(mask: str) -> str:
    """A wildcard mask (* and ?) as a case-insensitive whole-string pattern for ``rlike``."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in mask)
    return f"(?is)^{body}$"


def matches_mask(value: Column, mask: str) -> Column:
    """Whole-string wildcard match, case-insensitive; a null value doesn't match."""
    return F.coalesce(value.rlike(mask_regex(mask)), F.lit(False))


def matches_any_mask(path: Column, masks: list[str]) -> Column:
    """Whether a path, with backslashes, matches any mask; no masks match nothing."""
    test = F.lit(False)
    for mask in masks:
        test = test | matches_mask(slashes(path), mask.replace("/", "\\"))
    return test


def matches_pattern(value: Column, pattern: str) -> Column:
    """A mask without wildcards matches anywhere in the value; an empty pattern matches all."""
    if not pattern:
        return F.lit(True)
    return matches_mask(value, pattern if "*" in pattern or "?" in pattern else f"*{pattern}*")


def glob_list(raw: str) -> list[str]:
    """Semicolon-separated globs, lower-cased, with forward slashes and without blanks."""
    return [x.strip().lower().replace("\\", "/") for x in raw.split(";") if x.strip()]


def path_allowed(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Include and exclude globs; an empty path passes only if there is no include list."""
    norm = F.lower(F.translate(F.coalesce(path, F.lit("")), "\\", "/"))

    def any_of(globs: list[str]) -> Column:
        test = F.lit(False)
        for glob in globs:
            test = test | norm.rlike("(?s)^" + fnmatch.translate(glob).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$")
        return test

    return F.when(norm == "", F.lit(not include)).otherwise((any_of(include) if include else F.lit(True)) & ~any_of(exclude))


def parse_list(raw: Column, separators: str = "[;,]") -> Column:
    """Trimmed, non-empty items of a delimited list, in order."""
    return F.filter(F.transform(F.split(raw, separators), lambda x: F.trim(x)), lambda x: x != "")


def ordered_distinct(items: Column) -> Column:
    """Items of an array without later case-insensitive repeats; the first spelling stays."""
    return F.aggregate(
        items,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


def rule_id(value: Column) -> Column:
    """A rule id in upper case if it is W, C or O and digits, else null."""
    up = F.upper(F.trim(value))
    return F.when(up.rlike("^[WCO][0-9]+$"), up)


def rule_ids(raw: Column) -> Column:
    """Distinct valid rule ids of a delimited list, sorted; other tokens are discarded."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(parse_list(raw), rule_id), lambda x: x.isNotNull())))


def rule_id_from_line(line: Column) -> Column:
    """The rule id that starts a lint line, or null."""
    return F.nullif(F.upper(F.regexp_extract(line, r"^\s*([A-Za-z][0-9]{3})\b", 1)), F.lit(""))


def looks_like_path(value: Column) -> Column:
    """A drive anywhere, or a backslash and the suffix of a source file."""
    low = F.lower(value)
    ends = F.lit(False)
    for suffix in SOURCE_SUFFIXES:
        ends = ends | low.endswith(suffix)
    return F.contains(value, F.lit(":\\")) | (F.contains(value, F.lit("\\")) & ends)


def one_line(value: Column) -> Column:
    """Line ends become spaces and bars become slashes; trimmed."""
    return F.trim(F.translate(F.coalesce(value, F.lit("")), "\r\n|", "  /"))


def location(text: Column) -> Column:
    """``Module (123)`` as struct<module, line>; other text stays whole with line 0."""
    pattern = r"^(.*)\(\s*([+-]?[0-9]+)\s*\)$"
    line = F.regexp_extract(F.trim(text), pattern, 2).try_cast("int")
    name = F.when(line.isNotNull(), F.trim(F.regexp_extract(F.trim(text), pattern, 1))).otherwise(F.trim(text))
    return F.struct(name.alias("module"), F.coalesce(line, F.lit(0)).alias("line"))


def module_key(module: Column) -> Column:
    """The module name before the first slash of either kind, lower-cased."""
    return F.lower(F.regexp_extract(module, r"^([^\\/]*)", 1))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def message_or_dash(*values: Column) -> Column:
    """The first filled value, or a dash."""
    return F.coalesce(first_filled(*values), F.lit("-"))


def complexity_name(raw: Column) -> Column:
    """``Name (Tag)`` as struct<name, tag, is_routine>: an alphabetic tag in parentheses marks a routine."""
    name = F.regexp_extract(raw, r"^(.*?)\s*\(([A-Za-z]+)\)\s*$", 1)
    tag = F.regexp_extract(raw, r"^(.*?)\s*\(([A-Za-z]+)\)\s*$", 2)
    return F.struct(F.when(tag != "", name).otherwise(F.trim(raw)).alias("name"), tag.alias("tag"), (tag != "").alias("is_routine"))


def is_aggregate_name(name: Column) -> Column:
    """Rows of a complexity report that stand for sums: empty, Overall, or names that start with a backslash or hold an elided path."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (n == "") | (F.lower(n) == "overall") | F.startswith(n, F.lit("\\")) | F.contains(n, F.lit("\\...\\"))


def compiler_location(line: Column) -> Column:
    """``file(line[,col]):`` at the start of a compiler message as struct<file, line, col>; null if there is none."""
    pattern = r"^\s*(.+)\((\d+)(?:,(\d+))?\)\s*:"
    file = F.regexp_extract(line, pattern, 1)
    col = F.nullif(F.regexp_extract(line, pattern, 3), F.lit("")).cast("int")
    return F.when(file != "", F.struct(file.alias("file"), F.regexp_extract(line, pattern, 2).cast("int").alias("line"), col.alias("col")))


def identifier_at(line: Column, col: Column) -> Column:
    """The identifier that covers a 1-based column, or an empty string."""
    left = F.regexp_extract(F.substr(line, F.lit(1), F.greatest(col - 1, F.lit(0))), r"([A-Za-z_0-9]*)$", 1)
    right = F.regexp_extract(F.substr(line, col), r"^([A-Za-z_0-9]*)", 1)
    word = F.concat(left, right)
    return F.when(word.rlike("^[A-Za-z_]"), word).otherwise("")


def first_identifier(line: Column) -> Column:
    """The first identifier of a line that is no keyword, or an empty string."""
    words = F.regexp_extract_all(line, F.lit(r"([A-Za-z_][A-Za-z_0-9]*)"), F.lit(1))
    return F.coalesce(F.get(F.filter(words, lambda w: ~F.lower(w).isin(PASCAL_KEYWORDS)), F.lit(0)), F.lit(""))


def quoted_identifier(line: Column) -> Column:
    """The first identifier in single quotes, or an empty string."""
    return F.regexp_extract(line, r"'([A-Za-z_][A-Za-z_0-9.]*)'", 1)


def is_keyword(token: Column) -> Column:
    return F.lower(token).isin(PASCAL_KEYWORDS)


def strip_comment(line: Column) -> Column:
    """A line up to its first ``//``; strings are not recognised."""
    return F.regexp_replace(line, r"//.*$", "")


def word_position(line: Column, word: Column) -> Column:
    """The 1-based place of a whole word, case-insensitive, or 0."""
    return F.regexp_instr(F.lower(line), F.concat(F.lit(r"(?<![a-z0-9_])"), F.lower(word), F.lit(r"(?![a-z0-9_])")))


def occurrences(line: Column, word: Column) -> Column:
    """How often a whole word occurs, case-insensitive."""
    return F.regexp_count(F.lower(line), F.concat(F.lit(r"(?<![a-z0-9_])"), F.lower(word), F.lit(r"(?![a-z0-9_])")))


def is_valid_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z_][A-Za-z_0-9]*$"), F.lit(False))


def chars_outside_quotes(line: Column, char: str) -> Column:
    """How often a character occurs outside single-quoted strings."""
    bare = F.regexp_replace(line, "'[^']*'", "")
    return F.length(bare) - F.length(F.translate(bare, char, ""))


def resource_token(name: Column) -> Column:
    """A form resource name in upper case without a form-file suffix."""
    return F.regexp_replace(F.upper(F.trim(name)), r"[._]DFM$", "")


def resource_key(name: Column) -> Column:
    """The resource token without its type prefix T, so that both spellings join."""
    return F.regexp_replace(resource_token(name), "^T(?=.)", "")


def requested_resources(raw: Column) -> Column:
    """Sorted distinct resource tokens of a list split at commas or semicolons."""
    return F.array_sort(F.array_distinct(F.transform(parse_list(raw), resource_token)))


def xml_escape(value: Column) -> Column:
    out = F.replace(value, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def cmd_quote(value: Column) -> Column:
    """A command-line argument in double quotes, those inside doubled."""
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def slug(text: Column, most: int = 64) -> Column:
    """Lower case, runs of other than ASCII letters and digits as one dash, none at the ends, then cut to ``most``; ``unknown`` if empty."""
    body = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-")
    body = F.regexp_replace(body, "^-+|-+$", "")
    return F.when(body == "", "unknown").otherwise(F.left(body, F.lit(most)))


def compiler_target(text: Column) -> Column:
    """``Label (Platform)`` as struct<compiler, platform>; win32 and win64 get their usual spelling; without parentheses the platform is null."""
    pattern = r"^(.+?)\s*\(([^)]+)\)$"
    raw = F.nullif(F.trim(F.regexp_extract(F.trim(text), pattern, 2)), F.lit(""))
    platform = F.when(F.lower(raw) == "win32", "Win32").when(F.lower(raw) == "win64", "Win64").otherwise(raw)
    label = F.when(raw.isNotNull(), F.trim(F.regexp_extract(F.trim(text), pattern, 1))).otherwise(F.nullif(F.trim(text), F.lit("")))
    return F.struct(label.alias("compiler"), platform.alias("platform"))


def contains_flag(text: Column, flag: str) -> Column:
    """A switch that stands alone in a help text."""
    return F.coalesce(text.rlike(rf"(?<![A-Za-z0-9_-]){re.escape(flag)}(?![A-Za-z0-9_])"), F.lit(False))


def file_stem(path: Column) -> Column:
    """A unit's name from its file: no folder, no last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^\\/]*)$", 1), r"\.[^.]*$", "")


def emit_source_context(mode: str, is_error: Column) -> Column:
    """Whether a snippet is wanted: on, off, or auto for errors only."""
    return {"on": F.lit(True), "off": F.lit(False)}.get(mode.lower(), is_error)


def strip_root(line: Column, root: str) -> Column:
    """A log line without the project root, in any case of letters."""
    prefix = root.rstrip("\\/") + "\\"
    return F.regexp_replace(line, "(?i)" + re.escape(prefix), "")


def excluded_log_line(line: Column, masks: list[str]) -> Column:
    """Whether a log line names a masked file: only lines that start ``file(digits``; leading dots and backslashes go."""
    found = F.regexp_extract(line, r"^(.+?)\(\d+", 1)
    file = F.regexp_replace(F.trim(slashes(found)), r"^[.\\]+", "")
    return (found != "") & matches_any_mask(file, [m.replace("/", "\\").lstrip(".\\") for m in masks])


def is_framework_unit(name: Column) -> Column:
    """Units of the language's own framework, by prefix."""
    low = F.lower(name)
    test = F.lit(False)
    for prefix in FRAMEWORK_PREFIXES:
        test = test | F.startswith(low, F.lit(prefix.lower()))
    return test


def drive_path(path: Column) -> Column:
    """A trimmed path; one below a mounted drive (``/mnt/c/x``) becomes ``C:\\x``, other paths from a root slash have no drive and give null."""
    p = F.trim(path)
    drive = F.upper(F.regexp_extract(p, "^/[Mm][Nn][Tt]/([A-Za-z])(/|$)", 1))
    return F.when(~F.startswith(p, F.lit("/")), p).when(drive != "", F.concat(drive, F.lit(":\\"), slashes(F.substr(p, F.lit(8)))))


def absolute_path(path: Column, folder: str) -> Column:
    """A path with its drive and without dot segments, taken from ``folder`` if relative; null if empty or without a drive."""
    base = folder.replace("/", "\\").rstrip("\\")
    p = slashes(F.nullif(drive_path(path), F.lit("")))
    rooted = F.when(p.rlike(r"^([A-Za-z]:|\\\\)"), p).when(F.startswith(p, F.lit("\\")), F.concat(F.lit(base[:2]), p)).otherwise(F.concat(F.lit(base + "\\"), p))
    root = F.regexp_extract(rooted, r"^([A-Za-z]:|\\\\[^\\]+\\[^\\]+)", 1)
    kept = F.aggregate(
        F.split(F.substr(rooted, F.length(root) + 1), r"\\"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(root, F.lit("\\"), F.array_join(kept, "\\"))


def in_directory(path: Column, root: str) -> Column:
    """Whether a file lies under a directory, case-insensitive."""
    return F.startswith(F.lower(slashes(path)), F.lit(root.replace("/", "\\").rstrip("\\").lower() + "\\"))


def snippet_lines(file_lines: Column, target: Column, radius: int, style: str = "bar") -> Column:
    """``> 12 | text`` (bar) or ``=> 12: text`` (arrow) for the lines around ``target``; the target is marked."""
    first = F.greatest(target - radius, F.lit(1))
    last = F.least(target + radius, F.size(file_lines))
    shown = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def one(n: Column) -> Column:
        mark = F.when(n == target, "> " if style == "bar" else "=> ").otherwise("  " if style == "bar" else "   ")
        return F.concat(mark, n.cast("string"), F.lit(" | " if style == "bar" else ": "), F.get(file_lines, n - 1))

    return F.transform(shown, one)
