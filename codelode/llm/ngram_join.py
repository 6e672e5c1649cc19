"""N-gram Jaccard self-join: size-banded tiles, hashed bitmaps, exact verification, components.

Method. A document is the set of its distinct k-word shingles. Set sizes are cut
into geometric bands; a tile holds the pairs whose smaller set lies in one band.
In a tile, ``100 * inter >= 85 * union`` bounds the symmetric difference by some
d, so if the hash space is cut into more than d parts, two linked sets agree
exactly on at least one part that is not empty in both. Each document therefore
emits one key per non-empty part of its tiles; equal keys are the candidates.
Nothing is lost: a document with more empty parts than the tile's margin emits a
second and a third partition too, and a pair both of whose documents run out of
margins everywhere shares the keys of the empty parts. A key needs about five
equal shingles, so a passage shared by many documents makes few candidates.

Documents of equal sets form one class and only its smallest id takes part. Links
are first checked star-wise, each member of a key against the key's smallest id.
Keys that still mix components then become tiles of at most TILE members a side:
hashed bitmaps of at least four bits per shingle are compared, and as the bit
count of the XOR bounds the overlap from above, only pairs of different components
that can link leave the tile to be verified on whole texts by sorted-array intersection;
where they are many, each member's nearest first, until the merged components
leave few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.links import linked_components
from codelode.llm.shingles import WordHashes, ascii_words, mix, shingle_hashes
from codelode.llm.workers import kept
from codelode.session import broadcast_if_small, materialize, ship

_SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x2545F4914F6CDD1D)
#: A side is broadcast up to this many ids (8 bytes each); above it the join shuffles.
BROADCAST_IDS = 2_000_000
#: Members of one side of a tile.
TILE = 2048
#: Of a member's keys, so many of the most crowded travel with it.
TOPS = 8
MOST_BITS = 8192
#: Words of bitmaps compared at once.
CELLS = 1 << 21


def _words() -> WordHashes:
    """A worker's word hashes, some 10 MB: idle workers keep theirs beside the executor's heap."""
    return WordHashes(1 << 16)


def bands(num: int, den: int, growth: float = 1.5) -> "Bands":
    return Bands(num, den, growth)


class Bands:
    """Size bands [lo, next lo) such that linked sizes lie in one band or in neighbours."""

    def __init__(self, num: int, den: int, growth: float):
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            low = self.lows[-1]
            self.lows.append(max(low * den // num + 1, int(low * growth)))
        self.edges = np.array(self.lows)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def tiles(self, n: int) -> list[int]:
        """Its own band's tile, and the band below if a smaller partner can lie there."""
        band = self.of(n)
        reach = (self.lows[band] - 1) * self.den // self.num
        return [band - 1, band] if band and n <= reach else [band]

    def parts(self, tile: int) -> tuple[int, int]:
        """(parts, margin): more non-empty parts than the largest symmetric difference."""
        small = self.lows[tile + 1] - 1
        total = small + small * self.den // self.num
        most = total * (self.den - self.num) // (self.den + self.num)
        margin = 0 if most == 0 else 2 + most // 12
        return most + 1 + margin, margin


def part_keys(shingles: np.ndarray, cut: Bands) -> np.ndarray:
    """The candidate keys of one set (sorted distinct hashes)."""
    n = len(shingles)
    out = []
    for tile in cut.tiles(n):
        parts, margin = cut.parts(tile)
        for turn, seed in enumerate(_SEEDS):
            spread = mix(shingles ^ np.uint64(seed))
            part = ((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part.astype(np.intp), mix(spread))
            filled = np.bincount(part.astype(np.intp), minlength=parts) > 0
            empty = parts - int(filled.sum())
            last = turn == len(_SEEDS) - 1
            keep = np.arange(parts) if last and empty > margin else np.flatnonzero(filled)
            place = np.uint64(tile * len(_SEEDS) + turn) << np.uint64(40)
            out.append(mix(sums[keep] ^ mix(place + keep.astype(np.uint64))))
            if empty <= margin:
                break
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def bitmap(shingles: np.ndarray, per: int = 4) -> bytes:
    """Hashed bits of a set, ``per`` to twice as many a shingle, up to MOST_BITS; a longer bitmap folds to a shorter one by OR."""
    size = min(MOST_BITS, max(64, 1 << (per * len(shingles) - 1).bit_length())) if len(shingles) else 64
    bits = np.zeros(size, np.uint8)
    bits[(mix(shingles ^ np.uint64(7)) % np.uint64(size)).astype(np.intp)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, words: int) -> np.ndarray:
    out = np.frombuffer(bits, np.uint64)
    while len(out) > words:
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def _signatures(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cut = kept("words", _words), Bands(num, den, 1.5)
        for batch in batches:
            sizes, d0, d1, keys, bits = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_hashes(words.of(ascii_words(text.as_py())), k)
                sizes.append(len(s))
                d0.append(np.bitwise_xor.reduce(s) if len(s) else np.uint64(0))
                d1.append(mix(s ^ np.uint64(_SEEDS[0])).sum(dtype=np.uint64) if len(s) else np.uint64(0))
                keys.append(part_keys(s, cut).view(np.int64) if len(s) else np.empty(0, np.int64))
                bits.append(bitmap(s))
            if not sizes:
                continue
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(d0, np.uint64).view(np.int64)),
                    pa.array(np.array(d1, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))),
                    pa.array(bits, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "d0", "d1", "keys", "bits"],
            )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [pack.compress((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "packed"])


def _verified(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unpack = kept("words", _words), zstandard.ZstdDecompressor()

        def of(packed: bytes) -> np.ndarray:
            return shingle_hashes(words.of(unpack.decompress(packed).lower().split()), k)

        last, hub = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if a[i] != last:
                    last, hub = a[i], of(x.as_py())
                other = of(y.as_py())
                inter = len(np.intersect1d(hub, other, assume_unique=True))
                if den * inter >= num * (len(hub) + len(other) - inter):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"]
            )

    return run


def _tile_pairs(key: int, tile: pa.Table, num: int, den: int, most: int):
    """(a, b, key, whole): the pairs of one tile that may link and have no more crowded top key in common; over ``most`` per member, only each left member's nearest, and whole is false."""
    side, node, comp, size = (tile.column(c).to_numpy() for c in ("side", "node", "component", "n"))
    bits = tile.column("bits").to_pylist()
    tops = tile.column("tops").to_pylist()
    words = min(map(len, bits)) // 8
    table = np.array([folded(x, words) for x in bits])
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
    found, nearest, whole, count = [], [], True, 0
    step = max(1, CELLS // (len(right) * words))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        far = np.bitwise_count(table[rows][:, None, :] ^ table[right][None, :, :]).sum(axis=2, dtype=np.int64)
        total = size[rows][:, None] + size[right][None, :]
        ok = (comp[rows][:, None] != comp[right][None, :]) & ((num + den) * (total - far) >= 2 * num * total)
        ok &= den * np.minimum(size[rows][:, None], size[right][None, :]) >= num * np.maximum(size[rows][:, None], size[right][None, :])
        x, y = np.nonzero(ok)
        own = [next((t for t in tops[a] if t in tops[b]), key) == key for a, b in zip(rows[x].tolist(), right[y].tolist(), strict=True)]
        x, y = x[own], y[own]
        if not len(x):
            continue
        count += len(x)
        whole = whole and count <= most * len(node)
        if whole:
            found.append((node[rows[x]], node[right[y]]))
        order = np.lexsort((far[x, y] / total[x, y], x))
        first = order[np.concatenate([[True], x[order][1:] != x[order][:-1]])]
        nearest.append((node[rows[x[first]]], node[right[y[first]]]))
    for a, b in found if whole else nearest:
        yield a, b, whole


def _tiles(num: int, den: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile; one tile is held at a time."""
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            tile = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if len(tile.column("component").unique()) == 1:
                return
            key = tile.column("key")[0].as_py()
            for a, b, whole in _tile_pairs(key, tile, num, den, most):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([key] * len(a)), pa.array([whole] * len(a))], names=["a", "b", "key", "whole"])

        last = None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
            if not len(place):
                continue
            starts = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, [len(place)]])
            for x, y in zip(starts[:-1], starts[1:], strict=True):
                if held and tuple(place[x]) != last:
                    yield from close()
                last = tuple(place[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield from close()

    return run


def _cross(meta: DataFrame, num: int, den: int):
    def run(rows: DataFrame, most: int) -> DataFrame:
        """Tiles of the keys: blocks of members by a hash, every pair of blocks once. Keys of up to TILE members have one tile.

        Every member carries its TOPS most crowded keys. Two members that share one of them are compared at
        the first they share and nowhere else, so a key all of whose members share a more crowded one needs no tile.
        """
        crowd = F.slice(F.sort_array(F.collect_list(F.struct("m", "key")), asc=False), 1, TOPS)  # as many as a document's size allows
        placed = materialize(rows.join(rows.groupBy("node").agg(crowd.alias("tops")), "node"), "crowds")
        more = placed.select("key", "m", F.explode("tops").alias("t")).where(F.col("t") > F.struct("m", "key"))
        covered = more.groupBy("key", "m", "t").agg(F.count("*").alias("c")).where("c = m").select("key").distinct()
        placed = placed.join(broadcast_if_small(materialize(covered, "covered")), "key", "left_anti").withColumn("tops", F.col("tops.key"))
        blocks = F.ceil(F.col("m") / TILE).cast("int")
        rows = placed.join(meta, "node").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # side 0 is the left block, 2 the right one, 1 both (a block against itself)
        side = F.when(F.col("block") == F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2)
        tiled = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"), "node", "component", "n", "bits", "tops")
        tiled = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return tiled.mapInArrow(_tiles(num, den, most), "a long, b long, key long, whole boolean")

    return run


def _near(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose bit counts leave room for a link; rows of one pair of bitmap lengths are compared at once."""
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            bits = [batch.column(c).to_pylist() for c in ("bits_a", "bits_b")]
            words = np.array([min(len(x), len(y)) // 8 for x, y in zip(*bits, strict=True)], np.int64)
            far = np.zeros(len(words), np.int64)
            for w in np.unique(words).tolist():
                at = np.flatnonzero(words == w)
                left, right = (np.array([folded(side[i], w) for i in at.tolist()]) for side in bits)
                far[at] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            total = na + nb
            ok = pa.array(((num + den) * (total - far) >= 2 * num * total) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return run


def _only(rows: DataFrame, pairs: DataFrame, end: str) -> DataFrame:
    """The rows of one end of the pairs, where the pairs are few enough to be broadcast; else all."""
    return rows.join(F.broadcast(pairs.select(end).distinct()), end, "left_semi") if pairs.count() <= BROADCAST_IDS else rows


def _verifier(docs: DataFrame, meta: DataFrame, k: int, num: int, den: int):
    def prepare(nodes: DataFrame):
        """The check: sizes and bitmaps first; the texts of the pairs that they leave are packed, joined and compared."""
        ends = {end: meta.select(F.col("node").alias(end), F.col("n").alias("n" + end), F.col("bits").alias("bits_" + end)) for end in "ab"}

        def check(pairs: DataFrame) -> DataFrame:
            sided = _only(ends["b"], pairs, "b").join(broadcast_if_small(pairs), "b").join(_only(ends["a"], pairs, "a"), "a")
            near = materialize(sided.mapInArrow(_near(num, den), "a long, b long").distinct(), "near")
            if near.isEmpty():
                return near
            need = materialize(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "need")
            few = F.broadcast(need) if need.count() <= BROADCAST_IDS else need
            texts = docs.join(few, "doc_id", "left_semi").mapInArrow(_packed, "doc_id long, packed binary")
            texts = materialize(texts.groupBy("doc_id", F.xxhash64("packed")).agg(F.first("packed").alias("packed")).select("doc_id", "packed"), "texts")
            ta = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("pa"))
            tb = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("pb"))
            full = _only(tb, near, "b").join(broadcast_if_small(near), "b").join(_only(ta, near, "a"), "a").select("a", "b", "pa", "pb")
            return full.mapInArrow(_verified(k, num, den), "a long, b long")

        return check

    return prepare


def ngram_jaccard_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document of ``docs`` (doc_id, text, ...).

    Words are runs of characters other than space and U+0009-U+000D, A-Z lower-cased.
    Two documents link when ``den * intersection >= num * union`` of their shingle
    sets; component_id is the smallest doc_id reachable. Null and empty texts and
    texts without words have no shingles and are alone; a text under k words is one
    shingle. Rows that repeat a doc_id are one node and give one row each; rows
    without a doc_id keep a row with a null component. An empty table gives an
    empty result. Other columns are not read, so their names may clash.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, d0 long, d1 long, keys array<long>, bits binary"
    sigs = materialize(docs.mapInArrow(_signatures(k, num, den), schema), "sigs")

    # Equal sets are one class; its smallest id stands for it.
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("n_shingles", "d0", "d1").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("z")).where("rep <> z").drop("z")
    reps = broadcast_if_small(materialize(reps, "classes"))  # written, so that a crowded class's side of the join can be split
    member = full.select("doc_id", "n_shingles", "d0", "d1").join(reps, ["n_shingles", "d0", "d1"], "left")
    member = materialize(member.select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "member")
    # one document per class goes on: those that stand for none of their classes don't
    copies = materialize(member.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("stands")).where("not stands").select("doc_id"), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    alone = full.join(copies, "doc_id", "left_anti")

    posted = alone.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"))
    # once per node; different texts of a repeated id all stand for it
    meta = alone.groupBy(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "d0", "d1").agg(F.first("bits").alias("bits")).select("node", "n", "bits")
    meta = materialize(meta, "meta")  # every check and every round of tiles reads it
    comp = linked_components(posted, _verifier(docs, meta, k, num, den), _cross(meta, num, den))

    groups = member.distinct().join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    groups = groups.select("doc_id", F.coalesce("component", "rep").alias("component"))
    # a doc_id that repeats with different texts is one node: let its classes meet
    groups = groups.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sigs.select("doc_id", "n_shingles").join(groups, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
