"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over token positions: it hashes the tokens at some offsets
and ignores those between, so a substituted token under a gap doesn't hide a hit.
Test items and documents are hashed under every mask and joined on the hash (short items
under masks without gaps, which lose none of their substitutions); a hit
fixes a diagonal (document position less item position). The whole item is then
laid on the document along that diagonal, and the pair counts if some window of
``window`` item tokens (the whole item, if shorter) agrees in at least
``similarity`` of its places.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import materialize

#: Offsets read by each mask.
MASKS = ((0, 1, 2, 4, 5), (0, 2, 3, 5, 8))
#: From so many tokens on, some place of MASKS survives every pattern of substitutions that a window allows.
LONG = 16
#: Under so many tokens an item must stand in the document word for word.
WHOLE = 6
#: Seeds of test items, or ids of hit documents, that may be broadcast (about 16 bytes each); beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased words (runs of letters and digits), in order; scripts without spaces are cut into characters."""
    # Thai and Lao, Burmese, Khmer, kana, Han
    unspaced = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF])"
    text = F.when(text.rlike(unspaced), F.regexp_replace(text, unspaced, " $1 ")).otherwise(text)
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed_of(toks: Column, number: int, mask: tuple[int, ...]) -> Callable[[Column], Column]:
    return lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(number), *[F.get(toks, i + o) for o in mask]).alias("h"))


def _seeds(toks: Column, masks: list[tuple[int, tuple[int, ...]]]) -> Column:
    """(position, hash) of every place where a mask (number, offsets) fits."""
    parts = []
    for number, mask in masks:
        span = mask[-1] + 1
        at = F.when(F.size(toks) >= span, F.sequence(F.lit(0), F.size(toks) - span))

        parts.append(F.coalesce(F.transform(at, _seed_of(toks, number, mask)), F.array().cast("array<struct<pos:int,h:bigint>>")))
    return F.concat(*parts)


def _masks(items: DataFrame, similarity: float) -> list[tuple[str, list[tuple[int, tuple[int, ...]]]]]:
    """(which items, their masks): the two masks for long items; one run without gaps for short ones; the whole of the shortest.

    Of n tokens with s substitutions some run of n // (s + 1) tokens is whole, so the least such
    length of the short items there are finds them all.
    """
    n = F.size("it")
    run = F.floor(n / (n - F.ceil(n * similarity) + 1)).cast("int")
    short = (n >= WHOLE) & (n < LONG)
    least, whole = items.agg(F.min(F.when(short, run)), F.array_sort(F.collect_set(F.when(n < WHOLE, n)))).first()
    out = [(f"size(it) >= {LONG}", list(enumerate(MASKS)))]
    if least:
        out.append((f"size(it) >= {WHOLE} and size(it) < {LONG}", [(10, tuple(range(least)))]))
    return out + [(f"size(it) = {size}", [(20 + size, tuple(range(size)))]) for size in whole]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, bench: DataFrame, similarity: float = 0.8, window: int = 20) -> DataFrame:
    """(doc_id, item_id, start, item_start, matched, compared): where documents hold test items.

    One row per document and item that overlap, with the best window: token position
    in document and item, tokens that agree, tokens compared. ``docs`` has (doc_id,
    text, ...), ``bench`` (item_id, text, ...); other columns are not read, so their
    names may clash. Null or empty texts and null ids match nothing. Items under WHOLE
    tokens match word for word only. Texts are read whole, however long. Rows that repeat a
    document or an item give one row. Ties between windows go to the earliest. Empty
    tables give an empty result.
    """
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("it"))
    items = materialize(items.where("item_id is not null and size(it) > 0"), "items")
    masks = _masks(items, similarity)
    seeds = reduce(DataFrame.union, [
        items.where(which).select("item_id", F.size("it").alias("n"), F.explode(_seeds(F.col("it"), some)).alias("s")) for which, some in masks
    ]).select("item_id", "n", F.col("s.pos").alias("ipos"), F.col("s.h").alias("h"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    probe = texts.select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.explode(_seeds(F.col("t"), [m for _, some in masks for m in some])).alias("s"))
    probe = probe.select("doc_id", F.col("s.pos").alias("pos"), F.col("s.h").alias("h"))
    hits = probe.join(_small(seeds), "h").select("doc_id", "item_id", "n", (F.col("pos") - F.col("ipos")).alias("diag"))
    hits = materialize(hits.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "diag", "n")).alias("hits")), "hits")

    # Only documents with a hit are tokenized again. One row per document and diagonal goes on, with the tokens that the item covers.
    near = texts.join(_small(hits), "doc_id").select("doc_id", tokens(F.col("text")).alias("t"), "hits")
    covered = F.transform("hits", lambda x: F.struct(
        x["item_id"].alias("item_id"), x["diag"].alias("diag"), F.slice("t", F.greatest(x["diag"], F.lit(0)) + 1, x["n"] + F.least(x["diag"], F.lit(0))).alias("span")))
    near = near.select("doc_id", F.explode(covered).alias("x")).select("doc_id", "x.*")
    laid = near.join(_small(items), "item_id")
    n = F.size("it")
    lead = F.least("diag", F.lit(0))  # tokens of the item before the document begins, as a negative number
    agree = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.when((lead + j >= 0) & (F.get("span", lead + j) == F.get("it", j)), 1).otherwise(0),
    )
    laid = laid.select("doc_id", "item_id", "diag", agree.alias("agree"), F.least(n, F.lit(window)).alias("w"))
    sums = F.transform(F.sequence(F.lit(0), F.size("agree") - F.col("w")), lambda s: F.struct(
        F.aggregate(F.slice("agree", s + 1, F.col("w")), F.lit(0), lambda acc, x: acc + x).alias("matched"), (-s).alias("back")))
    best = laid.select("doc_id", "item_id", "diag", "w", F.array_max(sums).alias("m"))
    found = best.where(F.col("m.matched") >= F.when(F.col("w") < WHOLE, F.col("w")).otherwise(F.ceil(F.col("w") * similarity)))
    found = found.select("doc_id", "item_id", F.struct("m.matched", "w", (F.col("m.back") - F.col("diag")).alias("before"), "m.back").alias("k"))
    top = found.groupBy("doc_id", "item_id").agg(F.max("k").alias("k"))
    return top.select(
        "doc_id", "item_id", (-F.col("k.before")).alias("start"), (-F.col("k.back")).alias("item_start"),
        F.col("k.matched").alias("matched"), F.col("k.w").alias("compared"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, similarity: float = 0.8, window: int = 20) -> DataFrame:
    """``docs`` without the documents that hold a test item; its columns and its other rows stay.

    Null, empty and very long texts are treated as in ``contaminated``. Every row of an id that holds an item goes; rows without
    an id stay. An empty table, or an empty ``bench``, takes nothing away.
    """
    bad = contaminated(docs, bench, similarity, window).select("doc_id").distinct()
    bad = materialize(bad, "bad")
    return docs.join(_small(bad), "doc_id", "left_anti").select(*docs.columns)
