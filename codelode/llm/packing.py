"""Best-fit packing of token pieces into fixed windows by a grouping genetic algorithm.

Documents are tokenized whole; only those longer than the window are cut. Full
pieces fill a sequence each. The others are dealt at random to groups of a few
thousand pieces, and every group is worked on by ISLANDS islands. An island evolves a
small population of packings: a child takes one parent whole, gets the other's
best-filled bins injected, drops the bins that now hold a duplicate, and best-fits the
displaced pieces, longest first. Fitness is Falkenauer's mean squared fill. Where no island
reaches the lower bound, the elite bins of each migrate to its neighbour, which injects
them whole and evolves on; the fewest bins win. After each epoch bins full up to
``slack`` tokens stay, and the pieces of the others are dealt anew to fewer groups, until one
group holds all that is left or the epochs end.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import tokens
from codelode.session import broadcast_if_small, materialize, ship

ISLAND, ISLANDS = 4096, 2
#: Share of an island's bins that migrate.
ELITE = 0.3


def _pieces(source: Broadcast, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(source).encode
        closing = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [], [], [], [], []
                texts = [x or "" for x in batch.column(1).to_pylist()]
                for doc, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                    ids += closing
                    total = len(ids) // 4
                    first = total % window if total > window and total % window else min(total, window)
                    start, piece = 0, 0
                    while start < total:
                        length = first if piece == 0 else window
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        for column, value in zip(rows, (doc, piece, start, length, crc), strict=True):
                            column.append(value)
                        start, piece = start + length, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


Packing = list[list[int]]


def best_fit(bins: Packing, items: list[int], size: list[int], window: int) -> Packing:
    """Put the items, longest first, each into the fullest bin that has room, or a new one."""
    room = sorted((window - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for item in sorted(items, key=size.__getitem__, reverse=True):
        at = bisect.bisect_left(room, (size[item], -1))
        if at < len(room):
            free, k = room.pop(at)
            bins[k].append(item)
        else:
            free, k = window, len(bins)
            bins.append([item])
        bisect.insort(room, (free - size[item], k))
    return bins


def ranked(bins: Packing, size: list[int]) -> Packing:
    return sorted(bins, key=lambda b: sum(size[i] for i in b), reverse=True)


def inject(one: Packing, gift: Packing, size: list[int], window: int) -> Packing:
    """``one`` with the bins of ``gift`` in it, its bins with duplicates removed, and the displaced pieces best-fitted."""
    taken = {i for b in gift for i in b}
    kept, displaced = [], []
    for b in one:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return best_fit([list(b) for b in gift] + kept, displaced, size, window)


def crossover(one: Packing, two: Packing, size: list[int], window: int, share: float) -> Packing:
    """``one`` with the best-filled bins of ``two`` injected."""
    return inject(one, ranked(two, size)[: max(1, int(len(two) * share))], size, window)


def fitness(bins: Packing, size: list[int], window: int) -> float:
    """Mean squared fill; more for fewer, fuller bins."""
    return sum((sum(size[i] for i in b) / window) ** 2 for b in bins) / len(bins)


def lower_bound(size: list[int], window: int) -> int:
    return -(-sum(size) // window)


def evolve(size: list[int], window: int, seed: int, population: int = 6, generations: int = 40, start: Packing | None = None, guests: Packing | None = None) -> Packing:
    """The best packing of one island, from ``start`` (best fit, if none) and the elite bins of another. Stops early at the lower bound.

    Every island gets all its generations, whatever its size.
    """
    rng = np.random.default_rng(seed)
    bound = lower_bound(size, window)
    first = start or best_fit([], list(range(len(size))), size, window)
    if len(first) <= bound:
        return first
    pool = [first]
    if guests:
        pool.append(inject(first, guests, size, window))
    while len(pool) < population:
        # mutation of the first: some bins are dissolved and best-fitted anew in two parts
        out = {k for k in range(len(first)) if rng.random() < 0.15}
        loose = [i for k in out for i in first[k]]
        rng.shuffle(loose)
        half = len(loose) // 2
        part = best_fit([list(b) for k, b in enumerate(first) if k not in out], loose[:half], size, window)
        pool.append(best_fit(part, loose[half:], size, window))
    order = lambda x: (len(x[2]), -x[0], x[1])
    scored = sorted(((fitness(p, size, window), k, p) for k, p in enumerate(pool)), key=order)
    for stamp in range(len(scored), len(scored) + generations):
        if len(scored[0][2]) <= bound:
            break
        a, b = (scored[int(x)][2] for x in rng.permutation(len(scored))[:2])
        child = crossover(a, b, size, window, float(rng.uniform(0.1, 0.4)))
        if rng.random() < 0.5:  # the poorest bins and some others are dissolved, their pieces best-fitted anew in two parts
            full = ranked(child, size)
            drop = set(range(len(full) - 2, len(full))) | {int(x) for x in rng.integers(0, len(full), 4)}
            loose = [i for k in drop if k >= 0 for i in full[k]]
            rng.shuffle(loose)
            half = len(loose) // 2
            child = best_fit([b for k, b in enumerate(full) if k not in drop], loose[:half], size, window)
            child = best_fit(child, loose[half:], size, window)
        scored = sorted([*scored, (fitness(child, size, window), stamp, child)], key=order)[:population]
    return scored[0][2]


STATE = "grp long, island int, uid long, length long, bin long, offset long, fill long, bins long, met boolean, elite boolean"


def _state(key: tuple, uids: pd.Series, size: list[int], bins: Packing, window: int) -> pd.DataFrame:
    n = len(size)
    number, offset, fill, elite = (np.zeros(n, np.int64) for _ in range(4))
    for k, b in enumerate(ranked(bins, size)):
        at = 0
        for i in b:
            number[i], offset[i] = k, at
            at += size[i]
        fill[b] = at
        elite[b] = k < max(1, ELITE * len(bins))
    met = len(bins) <= lower_bound(size, window)
    return pd.DataFrame({"grp": int(key[0]), "island": int(key[1]), "uid": uids, "length": size, "bin": (int(key[0]) << 20) + number, "offset": offset, "fill": fill, "bins": len(bins), "met": met, "elite": elite > 0})


def _alone(window: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """An island's first packing. Where best fit meets the bound, the first island's is enough."""
        group = group.sort_values("uid", ignore_index=True)
        size = group["length"].tolist()
        first = best_fit([], list(range(len(size))), size, window)
        if key[1] and len(first) <= lower_bound(size, window):
            return _state(key, group["uid"][:0], [], [], window)
        return _state(key, group["uid"], size, evolve(size, window, seed=ISLANDS * int(key[0]) + int(key[1]) + 1, start=first), window)

    return run


def _with_guests(window: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """An island that goes on from its packing with the elite bins of its neighbour."""
        own = group[~group["guest"]].sort_values("uid", ignore_index=True)
        size, at = own["length"].tolist(), {u: i for i, u in enumerate(own["uid"].tolist())}
        start = [x.tolist() for _, x in own.groupby("bin").groups.items()]
        guests = [[at[u] for u in g["uid"]] for _, g in group[group["guest"]].sort_values(["bin", "offset"]).groupby("bin")]
        bins = evolve(size, window, seed=ISLANDS * int(key[0]) + int(key[1]) + 101, start=start, guests=guests)
        return _state(key, own["uid"], size, bins, window)

    return run


def _packed(dealt: DataFrame, window: int, epoch: int) -> DataFrame:
    """(uid, length, bin, offset, fill) of the best island of every group of ``dealt`` (grp, uid, length)."""
    islands = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    first = materialize(islands.groupBy("grp", "island").applyInPandas(_alone(window), STATE), f"epoch{epoch}")
    unmet = first.groupBy("grp").agg(F.max("met").alias("any")).where("not any").select("grp")
    unmet = broadcast_if_small(materialize(unmet, "unmet"))  # one row for ISLAND pieces
    evolving = first.join(unmet, "grp", "left_semi")
    guests = evolving.where("elite").withColumn("island", (F.col("island") + 1) % ISLANDS).withColumn("guest", F.lit(True))
    both = evolving.withColumn("guest", F.lit(False)).union(guests)
    second = both.groupBy("grp", "island").applyInPandas(_with_guests(window), STATE)
    both = materialize(first.join(unmet, "grp", "left_anti").union(second), f"met{epoch}")
    best = both.groupBy("grp").agg(F.min(F.struct("bins", "island")).alias("x")).select("grp", "x.island")
    return both.join(broadcast_if_small(materialize(best, "best")), ["grp", "island"])


def best_fit_packing(
    docs: DataFrame, tokenizer: str | None = None, window: int = 2048, end_id: int = 0, slack: int = 1, epochs: int = 4
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece of ``docs`` (doc_id, text, ...).

    ``tokenizer`` is the path of a ``tokenizers`` JSON file. Every document's ids end
    in ``end_id``. A null text is empty, so it has that one id. Very long texts are cut, never
    dropped. Of packings with equally many bins the better filled wins, then the older. Rows that
    repeat a document, or have no doc_id, are packed like any other row. An empty table gives
    an empty result. Other columns are not read, so their names may clash.
    """
    spark = docs.sparkSession
    ship(spark)
    source = tokens.vocabulary(spark, tokenizer or tokens.default_path())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    # the uid is fixed by writing it: a recomputed task can't change it afterwards
    cut = docs.mapInArrow(_pieces(source, window, end_id), schema).withColumn("uid", F.monotonically_increasing_id())
    cut = materialize(cut, "pieces")

    open_ = cut.where(F.col("length") < window).select("uid", "length")
    left = open_.count()
    placed = None
    for epoch in range(epochs):
        # group numbers start at epoch << 32 and bin numbers at group << 20, so bins never share a number
        groups = max(1, -(-left // ISLAND))
        last = groups == 1 or epoch == epochs - 1
        dealt = open_.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(epoch)), F.lit(groups)) + F.lit(epoch << 32))
        packed = _packed(dealt, window, epoch)
        done = F.lit(True) if last else F.col("fill") >= window - slack
        kept = packed.where(done).select("uid", "offset", "bin")
        placed = kept if placed is None else placed.union(kept)
        if last:
            break
        open_ = packed.where(~done).select("uid", "length")
        left = open_.count()
    out = cut.join(placed, "uid", "left")
    sequence = F.coalesce("bin", -F.col("uid") - 1)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))
