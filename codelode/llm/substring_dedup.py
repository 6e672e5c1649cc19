"""Substring dedup: paragraphs that repeat, whole or nearly, and passages that repeat inside paragraphs.

Paragraphs are lines. Those of ``min_words`` words get a MinHash of 40 values over
5-word shingles, cut into 10 bands of 4; at Jaccard 0.8 a pair shares a band with
probability 0.995, at 0.9 with 0.99998. Paragraphs of equal words are one node; nodes
that share a band are joined, checked by exact Jaccard on their words, and clustered
by connected components: first each with its band's smallest node, then, where a band still
mixes components, every pair whose sizes and hashed bitmaps leave room for a link.

A passage copied into the middle of another paragraph has no line of its own, so
each text is also cut into sub-paragraphs at places that its words alone choose
(minima of a rolling hash), the same in every copy. Those of equal words repeat;
neighbours that do are joined to passages, kept from ``min_passage`` words on (a
copy of w words loses less than two sub-paragraphs, of 9 words each on average, at its ends).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.links import linked_components
from codelode.llm.ngram_join import _cross, bitmap
from codelode.llm.shingles import _MUL, WordHashes, _S32, mix, shingle_hashes
from codelode.llm.workers import kept
from codelode.session import broadcast_if_small, materialize, ship

BANDS, ROWS, SHINGLE, REACH, LONGEST = 10, 4, 5, 4, 16
#: Documents whose asked-for places may be broadcast (about 100 bytes each); beyond it the join shuffles.
BROADCAST_PLACES = 100_000
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
LINE, PART = 0, 1
#: Bits a shingle in the bitmaps of paragraphs: so many that few collide, as templates bring many pairs just under the threshold.
BITS = 32


def lines(text: str | None) -> list[list[bytes]]:
    """The words of each line of a text; lines end at line feeds, words are cut at ASCII white space, A-Z lower-cased."""
    return [x.split() for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def cuts(hashes: np.ndarray) -> np.ndarray:
    """Where sub-paragraphs start: words whose rolling two-word hash is the least within REACH words on either side."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.intp)
    rolled = mix(hashes[:-1] ^ ((hashes[1:] << np.uint64(1)) | (hashes[1:] >> np.uint64(63)))) if n > 1 else hashes[:0]
    big = np.full(REACH, np.iinfo(np.uint64).max)
    v = np.concatenate([big, rolled, big])
    m = len(rolled)
    ok = np.ones(m, bool)
    for j in range(1, REACH + 1):
        ok &= v[REACH : REACH + m] < v[REACH - j : REACH - j + m]
        ok &= v[REACH : REACH + m] <= v[REACH + j : REACH + j + m]
    at = np.flatnonzero(ok)
    at = np.concatenate([[0], at[at > 0]]).astype(np.intp)
    # runs of few words have no least one: there, every LONGEST words
    gaps = np.diff(np.append(at, n))
    if gaps.max() > 2 * LONGEST:
        at = np.concatenate([np.arange(a, a + g, LONGEST) if g > 2 * LONGEST else [a] for a, g in zip(at, gaps, strict=True)]).astype(np.intp)
    return at


def _content(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of words: sums of word hashes mixed with their places in the run."""
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(starts, sizes) + place
    mixed = mix(hashes[at] ^ mix(place.astype(np.uint64) + np.uint64(17)))
    return mix(np.add.reduceat(mixed, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("words", WordHashes)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                docs, kinds, starts, sizes, keys, bands = [], [], [], [], [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    by_line = lines(text.as_py())
                    hashes = words.of([w for line in by_line for w in line])
                    if not len(hashes):
                        continue
                    n = np.array([len(x) for x in by_line])
                    first = np.cumsum(n) - n
                    long = n >= min_words
                    n, first = n[long], first[long]
                    if len(n):
                        acc = hashes[: len(hashes) - SHINGLE + 1].copy()
                        for i in range(1, SHINGLE):
                            acc = (acc ^ (acc >> _S32)) * _MUL + hashes[i : len(hashes) - SHINGLE + 1 + i]
                        acc = mix(acc)
                        within = n - SHINGLE + 1
                        offsets = np.cumsum(within) - within
                        pick = np.repeat(first - offsets, within) + np.arange(int(within.sum()))
                        least = np.minimum.reduceat(acc[pick][None, :] * _ODD[:, None], offsets, axis=1)
                        banded = np.zeros((BANDS, len(n)), np.uint64)
                        for r in range(ROWS):
                            banded = mix(banded ^ least[r::ROWS][:BANDS])
                        banded = mix(banded + np.arange(BANDS, dtype=np.uint64)[:, None])
                        docs.append(np.full(len(n), doc if doc is not None else 0))
                        kinds.append(np.full(len(n), LINE))
                        starts.append(first)
                        sizes.append(n)
                        keys.append(_content(hashes, first, n))
                        bands.append(banded.T)
                    start = cuts(hashes)
                    size = np.diff(np.append(start, len(hashes)))
                    docs.append(np.full(len(start), doc if doc is not None else 0))
                    kinds.append(np.full(len(start), PART))
                    starts.append(start)
                    sizes.append(size)
                    keys.append(_content(hashes, start, size))
                    bands.append(np.empty((len(start), 0), np.uint64))
                if not docs:
                    continue
                ends = np.concatenate([[0], np.cumsum(np.concatenate([np.full(len(b), b.shape[1]) for b in bands]))])
                flat = np.concatenate([b.ravel() for b in bands]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(docs).astype(np.int64)),
                        pa.array(np.concatenate(kinds).astype(np.int32)),
                        pa.array(np.concatenate(starts).astype(np.int64)),
                        pa.array(np.concatenate(sizes).astype(np.int64)),
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
                    ],
                    names=["doc_id", "kind", "start", "n_words", "h", "bands"],
                )

    return run


def _cited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, words) of the places asked for in each document, where its words have that hash."""
    hashed = kept("words", WordHashes)
    for batch in batches:
        out_h, out_words = [], []
        for text, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            flat = [w for line in lines(text.as_py()) for w in line]
            for place in places:
                run = flat[place["start"] : place["start"] + place["n_words"]]
                if not run or int(_content(hashed.of(run), np.array([0]), np.array([len(run)])).view(np.int64)[0]) != place["h"]:
                    continue  # another text under a repeated id
                out_h.append(place["h"])
                out_words.append(b" ".join(run))
        yield pa.RecordBatch.from_arrays([pa.array(out_h, pa.int64()), pa.array(out_words, pa.binary())], names=["h", "words"])


def _similar(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("words", WordHashes)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (shingle_hashes(words.of(v.as_py().split()), SHINGLE) for v in (x, y))
                inter = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * inter >= num * (len(a) + len(b) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, bits): the number of distinct shingles of a paragraph and their hashed bits."""
    hashed = kept("words", WordHashes)
    for batch in batches:
        sets = [shingle_hashes(hashed.of(x.as_py().split()), SHINGLE) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s, BITS) for s in sets], pa.binary())], names=["node", "n", "bits"])


def repeated_passages(docs: DataFrame, min_words: int = 20, num: int = 80, den: int = 100, min_passage: int = 15) -> DataFrame:
    """(doc_id, start_word, n_words, cluster_id, kind, removed): every repeated paragraph and passage of ``docs``.

    Words are counted over the whole text, from 0, as runs of characters other than
    ASCII white space. kind is paragraph or passage; a passage that lies in a listed paragraph
    is not listed again. cluster_id names the group of alike paragraphs (or the first
    sub-paragraph of a passage). removed is false for the first place of a group, by
    doc_id and word, which stays. Null and empty texts and texts under ``min_passage``
    words hold none; a text that repeats itself within one document counts. Rows that
    repeat an id are one document's places; rows without an id take no part. An
    empty table gives an empty result. Other columns are not read, so their names may clash.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    units = docs.mapInArrow(_units(min_words), "doc_id long, kind int, start long, n_words long, h long, bands array<long>")
    units = materialize(units, "units")

    # Groups of equal words, with their first place; map-side sums keep a hot group small.
    place = F.min(F.struct("doc_id", "start", "n_words"))
    line_nodes = materialize(
        units.where(F.col("kind") == LINE).groupBy("h").agg(F.count("*").alias("c"), place.alias("p"), F.first("bands").alias("bands")), "nodes"
    )

    words_of: list[DataFrame] = []

    def prepare(nodes: DataFrame):
        """Fetch the words of the nodes once, from each one's first place; the check joins pairs with them."""
        need = nodes.select(F.col("node").alias("h"))
        where = line_nodes.select("h", "p.*").join(need, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "n_words")).alias("places"))
        where = materialize(where, "places")
        small = F.broadcast(where) if where.count() <= BROADCAST_PLACES else where
        cited = docs.join(small, "doc_id").select("text", "places").mapInArrow(_cited, "h long, words binary")
        cited = materialize(cited.groupBy("h").agg(F.max("words").alias("words")), "cited")
        words_of.append(cited)
        ca = cited.select(F.col("h").alias("a"), F.col("words").alias("wa"))
        cb = cited.select(F.col("h").alias("b"), F.col("words").alias("wb"))

        def check(pairs: DataFrame) -> DataFrame:
            full = cb.join(broadcast_if_small(pairs), "b").join(ca, "a").select("a", "b", "wa", "wb")
            return full.mapInArrow(_similar(num, den), "a long, b long")

        return check

    def cross(rows: DataFrame, most: int) -> DataFrame:
        """The pairs of mixed buckets that may link, by tiles of bitmaps of the words that the check holds."""
        asked = words_of[-1].join(broadcast_if_small(materialize(rows.select(F.col("node").alias("h")).distinct(), "asked")), "h", "left_semi")
        return _cross(asked.select("h", "words").mapInArrow(_bitmaps, "node long, n long, bits binary"), num, den)(rows, most)

    buckets = line_nodes.select(F.explode("bands").alias("key"), F.col("h").alias("node"))
    comp = linked_components(buckets, prepare, cross)
    named = line_nodes.select("h", "c", "p").join(comp.select(F.col("node").alias("h"), "component"), "h", "left")
    named = named.select("h", "c", "p", F.coalesce("component", "h").alias("cluster_id"))
    groups = named.groupBy("cluster_id").agg(F.sum("c").alias("c"), F.min("p").alias("first")).where("c > 1")
    repeated = materialize(named.join(groups.select("cluster_id", "first"), "cluster_id").select("h", "cluster_id", "first"), "repeated")
    found = units.where(F.col("kind") == LINE).select("doc_id", "start", "n_words", "h").join(repeated, "h")
    paragraphs = materialize(
        found.select(
            "doc_id", F.col("start").alias("start_word"), "n_words", "cluster_id", F.lit("paragraph").alias("kind"),
            F.struct("doc_id", "start").alias("at") != F.struct("first.doc_id", "first.start"),
        ).toDF("doc_id", "start_word", "n_words", "cluster_id", "kind", "removed"),
        "paragraphs",
    )

    parts = units.where(F.col("kind") == PART).select("doc_id", "start", "n_words", "h")
    twice = parts.groupBy("h").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "start")).alias("first")).where("c > 1").drop("c")
    hits = parts.join(materialize(twice, "twice"), "h")
    hits = hits.withColumn("removed", F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", "n_words", "h", "removed")
    in_order = Window.partitionBy("doc_id").orderBy("start")
    ends = F.lag(F.col("start") + F.col("n_words")).over(in_order)
    breaks = F.coalesce((ends != F.col("start")) | (F.lag("removed").over(in_order) != F.col("removed")), F.lit(True))
    runs = hits.withColumn("new", breaks.cast("int")).withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "run", "removed").agg(
        F.min("start").alias("start_word"), F.sum("n_words").alias("n_words"), F.min_by("h", "start").alias("cluster_id")
    ).where(F.col("n_words") >= min_passage)
    # passages that no listed paragraph covers
    p = paragraphs.select("doc_id", F.struct("start_word", "n_words").alias("line"))
    covers = p.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    open_runs = runs.join(covers, "doc_id", "left").where(
        ~F.coalesce(F.exists("lines", lambda x: (x["start_word"] <= F.col("start_word")) & (x["start_word"] + x["n_words"] >= F.col("start_word") + F.col("n_words"))), F.lit(False))
    )
    passages = open_runs.select("doc_id", "start_word", "n_words", "cluster_id", F.lit("passage").alias("kind"), "removed")
    return paragraphs.union(passages)
