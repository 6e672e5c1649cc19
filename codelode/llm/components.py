"""Connected components of an edge list, distributed, with lineage cut through the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import materialize, ship

#: Up to this many edges one task finds the components in one pass; beyond it, rounds are dealt out by node.
ONE_TASK = 20_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all the edges (u, v), by union-find; a root is its tree's smallest node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((find(root.setdefault(u, u)), find(root.setdefault(v, v))))
            root[high] = low
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Up to ONE_TASK edges one task finishes. More alternate large-star and small-star until the edge set stops changing.
    Each half groups by node with map-side minima and joins the minima back, so
    a hub with a third of all edges is pre-aggregated and its join side can be
    split; the rounds grow with the logarithm of the longest path. Null ends and
    self-loops are ignored; an empty edge list gives an empty result.
    """
    ship(edges.sparkSession)
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = materialize(e.where("u is not null and v is not null and u <> v").distinct(), tag)
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        if state[0] <= ONE_TASK:
            return e.select("u", "v").coalesce(1).mapInArrow(_forest, "node long, component long")
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")
        )
        e = materialize(small.select("x.*").where("u <> v").distinct(), tag)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
