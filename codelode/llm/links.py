"""From candidate buckets to components: checks that lose no link and expand no group into all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.components import connected_components
from codelode.session import broadcast_if_small, materialize, settled

#: Keys of about so many members and more are crowded; counted on one node of SAMPLED.
CROWDED, SAMPLED = 512, 16
Pairs = Callable[[DataFrame], DataFrame]


def linked_components(buckets: DataFrame, verify: Callable[[DataFrame, DataFrame], Pairs], cross: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the nodes that link, from ``buckets`` (key, node) of candidates.

    ``verify(nodes)`` prepares a check of pairs (a, b) of these nodes and returns it.
    First each node is checked with the smallest node of its buckets, the one it
    shares most keys with; then the other smallest nodes that would still join two
    components. ``cross(rows, most)`` then gets (key, node, m, component) of buckets
    that mix components and names the pairs (a, b, key, whole) that may link: all of a
    bucket, or, over ``most`` a member, each node's likeliest. Those are checked and
    merged, and the buckets that weren't whole are asked again, at last without a limit.
    """
    return broadcast_if_small(settled(buckets.sparkSession, lambda: _linked(buckets, verify, cross), "linked"))


def _linked(buckets: DataFrame, verify: Callable[[DataFrame, DataFrame], Pairs], cross: Callable[[DataFrame, int], DataFrame] | None) -> DataFrame:
    # Few members: one shuffle brings them together. Crowded keys are split: their minima are combined before they
    # shuffle and sent to the members. Which way a key goes doesn't change its rows.
    some = buckets.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).groupBy("key").agg(F.count("*").alias("c"))
    crowded = broadcast_if_small(materialize(some.where(F.col("c") >= CROWDED // SAMPLED).select(F.col("key").alias("hot")), "crowded"))
    first = F.first("node").over(Window.partitionBy("key").orderBy("node"))
    is_hot = F.col("key") == F.col("hot")
    split = buckets.join(crowded, is_hot, "left_semi")
    heads = materialize(split.groupBy("key").agg(F.min("node").alias("a")), "heads")
    stars = buckets.join(crowded, is_hot, "left_anti").withColumn("a", first).unionByName(split.join(broadcast_if_small(heads), "key"))
    stars = stars.where("a <> node").select("key", "a", F.col("node").alias("b"))
    stars = materialize(stars.distinct(), "stars")
    pairs = materialize(stars.groupBy("a", "b").agg(F.count("*").alias("c")), "pairs")
    check = verify(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b")
    best = materialize(best, "best")
    links = materialize(check(best), "links")
    comp = _components(links)

    def of(end: str) -> DataFrame:
        return comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))

    rest = pairs.join(broadcast_if_small(best), ["a", "b"], "left_anti").select("a", "b").join(of("b"), "b", "left").join(of("a"), "a", "left")
    rest = materialize(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "rest")
    if not rest.isEmpty():
        links = materialize(links.union(check(rest)), "links")
        comp = _components(links)
    if cross is None:
        return comp

    members = stars.select("key", F.col("b").alias("node")).union(stars.select("key", F.col("a").alias("node")).distinct())
    tried = pairs.select("a", "b")
    for most in (4, 16, 1 << 40):
        placed = members.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        # keys of the same members ask for the same pairs, so one of them stands for all
        same = [F.bit_xor(F.xxhash64("node")).alias("s0"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s1")]
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), *same)
        mixed = materialize(mixed.where("lo <> hi and m > 2").groupBy("m", "s0", "s1").agg(F.min("key").alias("key")).select("key", "m"), "keys")
        rows = materialize(placed.join(broadcast_if_small(mixed), "key"), "mixed")
        named = materialize(cross(rows, most), "named")
        ask = materialize(named.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "ask")
        if not ask.isEmpty():
            tried = tried.union(ask)
            links = materialize(links.union(check(ask)), "links")
            comp = _components(links)
        open_keys = materialize(named.where("not whole").select("key").distinct(), "open")
        if open_keys.isEmpty():  # every pair of different components that can link has been checked
            break
        members = rows.join(broadcast_if_small(open_keys), "key", "left_semi").select("key", "node")
    return comp


def _components(links: DataFrame) -> DataFrame:
    return broadcast_if_small(materialize(connected_components(links), "components"))
