"""Nearest neighbours by largest inner product: one vantage-point tree per shard.

Inner products become Euclidean distances by one more coordinate, sqrt(M^2 - |x|^2)
with M the largest norm, which is 0 in queries. A tree node splits its points at
the median distance to a vantage point and keeps the range of distances of each
half; the triangle inequality then bounds from below how near a query can come. A
half is skipped when that bound times ``factor`` exceeds the distance of the k-th
best so far; factor 1 is exact, larger factors skip more. Every vector is in
exactly one shard's tree. Query blocks visit every shard, one tree and one block
in memory at a time. Equal vectors are indexed by their k + 1 smallest ids only:
no result can hold more of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.session import materialize, ship

LEAF = 256


class VantagePointTree:
    """Nodes as nested tuples over rows of ``points``; ``ids`` are ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top_norm: float, seed: int = 0):
        self.ids, self.vectors = ids, vectors
        extra = np.sqrt(np.maximum(top_norm**2 - (vectors**2).sum(axis=1), 0.0))
        self.points = np.hstack([vectors, extra[:, None]])
        rng = np.random.default_rng(seed)
        self.root = self._node(np.arange(len(ids)), rng)

    def _node(self, rows: np.ndarray, rng: np.random.Generator) -> tuple:
        if len(rows) <= LEAF:
            return ("leaf", rows)
        # the vantage point of the widest spread among a few
        best, spread = None, -1.0
        sample = self.points[rng.choice(rows, min(64, len(rows)), replace=False)]
        for at in rng.choice(rows, 4, replace=False):
            width = float(np.linalg.norm(sample - self.points[at], axis=1).std())
            if width > spread:
                best, spread = at, width
        d = np.linalg.norm(self.points[rows] - self.points[best], axis=1)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = order[:half], order[half:]
        ranges = (d[inner[0]], d[inner[-1]], d[outer[0]], d[outer[-1]])
        return ("split", int(best), ranges, self._node(rows[inner], rng), self._node(rows[outer], rng))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best per query, -1 and -inf where there are fewer; the query's own id is left out."""
        q = np.hstack([queries, np.zeros((len(queries), 1))])
        norms = (q**2).sum(axis=1)
        spare = k + 8  # so that rounding in matrix products can't cost a place; the exact scores come last
        best = np.full((len(q), spare), -np.inf)
        rows_of = np.full((len(q), spare), -1)
        top = float((self.points**2).sum(axis=1).max()) if len(self.ids) else 0.0

        def visit(node: tuple, active: np.ndarray) -> None:
            if not len(active):
                return
            if node[0] == "leaf":
                rows = node[1]
                scores = queries[active] @ self.vectors[rows].T
                scores[query_ids[active][:, None] == self.ids[rows][None, :]] = -np.inf
                both = np.hstack([best[active], scores])
                which = np.hstack([rows_of[active], np.broadcast_to(rows, (len(active), len(rows)))])
                pick = np.argpartition(-both, spare - 1, axis=1)[:, :spare] if both.shape[1] > spare else np.argsort(-both, axis=1)
                best[active] = np.take_along_axis(both, pick, axis=1)
                rows_of[active] = np.take_along_axis(which, pick, axis=1)
                return
            _, vantage, (a0, a1, b0, b1), inner, outer = node
            d = np.linalg.norm(q[active] - self.points[vantage], axis=1)
            low_in = np.maximum(np.maximum(d - a1, a0 - d), 0.0)
            low_out = np.maximum(np.maximum(d - b1, b0 - d), 0.0)
            near = d <= (a1 + b0) / 2

            def reach(low: np.ndarray) -> np.ndarray:
                kth = best[active].min(axis=1)
                # the distance that goes with the k-th inner product, rounded up a little
                limit = np.sqrt(np.maximum(norms[active] + top - 2 * np.where(np.isfinite(kth), kth, 0), 0))
                return ~np.isfinite(kth) | (low * factor <= limit * (1 + 1e-9))

            visit(inner, active[near & reach(low_in)])
            visit(outer, active[~near & reach(low_out)])
            visit(outer, active[near & reach(low_out)])
            visit(inner, active[~near & reach(low_in)])

        visit(self.root, np.arange(len(q)))
        ids = np.where(rows_of >= 0, self.ids[rows_of], -1)
        exact = np.zeros(rows_of.shape)
        for i in range(queries.shape[1]):  # in the order of the components, so the sum is the same everywhere
            exact += queries[:, i : i + 1] * self.vectors[rows_of, i]
        exact[~np.isfinite(best)] = -np.inf
        ids[~np.isfinite(best)] = np.iinfo(np.int64).max
        order = np.lexsort((ids, -exact), axis=1)[:, :k]
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(exact, order, axis=1)


def _build(top_norm: float):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", ignore_index=True)
        tree = VantagePointTree(group["vec_id"].to_numpy(np.int64), np.array(group["v"].tolist(), float), top_norm, seed=int(key[1]) + 1)
        return pd.DataFrame({"dim": [int(key[0])], "shard": [int(key[1])], "kind": [0], "block": [0], "body": [pickle.dumps(tree)]})

    return run


def _block(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    body = pickle.dumps((group["vec_id"].to_numpy(np.int64), np.array(group["v"].tolist(), float)))
    return pd.DataFrame({"dim": [int(key[0])], "kind": [1], "block": [int(key[1])], "body": [body]})


def _searched(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, place = None, None
        for batch in batches:
            for dim, shard, kind, body in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if kind == 0:
                    tree, place = pickle.loads(body.as_py()), (dim, shard)
                    continue
                if place != (dim, shard):  # no vector of this length in the shard
                    continue
                query_ids, queries = pickle.loads(body.as_py())
                ids, scores = tree.search(query_ids, queries, k, factor)
                ok = np.isfinite(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query_ids, ids.shape[1])[ok.ravel()]), pa.array(ids[ok]), pa.array(scores[ok])],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def nearest_neighbours(
    vectors: DataFrame, queries: Column | None = None, k: int = 20, factor: float = 1.05, shard_rows: int = 8192, block_rows: int = 1024
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query among the other rows.

    ``vectors`` has (vec_id, embedding, ...); ``queries`` says which rows are queries
    (all by default). Null or zero vectors, vectors with null, NaN or infinite
    components and rows without an id take no part; vectors of different lengths are
    never compared. Ties go to the smaller id; fewer candidates than ``k`` are all
    returned. Of rows that repeat an id and a vector one counts. An empty table
    gives an empty result. Other columns are not read, so their names may clash.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    rows = materialize(rows.withColumn("is_query", F.coalesce(queries if queries is not None else F.lit(True), F.lit(False))), "vectors")

    same = Window.partitionBy("v").orderBy("vec_id")
    indexed = rows.select("vec_id", "v").distinct().withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, top, asked = rows.agg(F.count("*"), F.max(norm), F.count_if("is_query")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    trees = indexed.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    trees = trees.applyInPandas(_build(float(top or 0.0)), "dim int, shard int, kind int, block int, body binary")
    trees = materialize(trees, "trees")
    asked_rows = rows.where("is_query").select("vec_id", "v").distinct()
    asked_rows = asked_rows.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int").alias("block"))
    asked_rows = asked_rows.applyInPandas(_block, "dim int, kind int, block int, body binary")
    visits = asked_rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(*trees.columns)
    # Of each task's rows, a shard's tree comes first and its query blocks follow.
    meet = trees.union(visits).repartition(max(shards, 1), "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "block")
    found = meet.select("dim", "shard", "kind", "body").mapInArrow(_searched(k, factor), "query_id long, vec_id long, score double").distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
