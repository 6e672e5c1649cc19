"""Dependency-graph operators: edges, reachability, cycles, scores, hotspots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.codes import EDGE_KINDS, hotspot_hint, hotspot_rank_of_kind, ordinal
from codelode.session import materialize

#: Graphs of up to this many edges are worked in one partition, without shuffles between rounds.
ONE_TASK = 20_000


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, edge_kind, seq) trimmed, without blanks, one per case-insensitive key; the first spelling stays."""
    e = edges.withColumns({"src": F.trim("src"), "dst": F.trim("dst")}).where("src <> '' and dst <> ''")
    first = F.min_by(F.struct("src", "dst", "edge_kind"), "seq")
    keys = [F.lower("src").alias("ks"), F.lower("dst").alias("kd"), F.col("edge_kind").alias("kk")]
    return e.groupBy(*keys).agg(first.alias("e"), F.min("seq").alias("seq")).select("e.*", "seq")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (name, path, is_project_unit, resolution_rank, seq) merged by name: first path, highest resolution, any project flag."""
    return nodes.groupBy("name").agg(
        F.min_by("path", F.when(F.coalesce("path", F.lit("")) != "", F.col("seq"))).alias("path"),
        F.max("is_project_unit").alias("is_project_unit"),
        F.max("resolution_rank").alias("resolution_rank"),
    )


def eligible(nodes: DataFrame) -> DataFrame:
    """Names of resolved project units."""
    return nodes.where("is_project_unit and resolution_rank = 0").select("name").distinct()


def adjacency(edges: DataFrame, names: DataFrame, reverse: bool = False) -> DataFrame:
    """Distinct (src, dst) with both ends among ``names``; turned round if ``reverse``."""
    a = edges.join(names.select(F.col("name").alias("src")), "src", "left_semi").join(names.select(F.col("name").alias("dst")), "dst", "left_semi")
    return (a.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else a.select("src", "dst")).distinct()


def _one_task(df: DataFrame, n: int) -> DataFrame:
    return df.coalesce(1) if n <= ONE_TASK else df


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): every node on a path from each of ``starts`` (name), itself included. One frontier step a round."""
    adj = materialize(edges.select("src", "dst").distinct(), "adj")
    small = adj.count()
    adj = _one_task(adj, small)
    seen = frontier = materialize(starts.select(F.col("name").alias("start"), F.col("name").alias("node")).distinct(), "frontier")
    while True:
        step = frontier.join(adj, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = materialize(_one_task(step, small).join(_one_task(seen, small), ["start", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def _spread(values: DataFrame, adj: DataFrame, n: int) -> DataFrame:
    """Least label that reaches each node along ``adj``: (node, label), to a fixpoint."""
    state = None
    while True:
        told = values.join(adj, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label")
        values = materialize(_one_task(values.union(told), n).groupBy("node").agg(F.min("label").alias("label")), "labels")
        now = values.agg(F.count("*"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()
        if now == state:
            return values
        state = now


def strongly_connected(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, root): the strongly connected component of each node, named by its least member.

    Forward-backward colouring: every node takes the least name that reaches it; the
    nodes of a colour that also reach that name are its component and leave the
    graph. No transitive closure is built, so state stays linear in the edges.
    Nodes without an edge in or out are components of their own from the start.
    """
    todo = materialize(names.select(F.col("name").alias("node")).distinct(), "todo")
    adj = materialize(adjacency(edges, names).where("src <> dst"), "adj")
    done = None
    while True:
        n = adj.count()
        adj = _one_task(adj, n)
        inner = materialize(_one_task(adj.select(F.col("src").alias("node")).intersect(adj.select(F.col("dst").alias("node"))), n), "inner")
        single = todo.join(inner, "node", "left_anti").select(F.col("node").alias("name"), F.col("node").alias("root"))
        done = single if done is None else done.union(single)
        if inner.isEmpty():
            return done
        todo = inner
        kept = adj.join(todo.toDF("src"), "src", "left_semi").join(todo.toDF("dst"), "dst", "left_semi").select("src", "dst")
        kept = materialize(_one_task(kept, n), "adj")
        colour = _spread(todo.select("node", F.col("node").alias("label")), kept, n)
        same = kept.join(colour.toDF("src", "c1"), "src").join(colour.toDF("dst", "c2"), "dst").where("c1 = c2")
        back = materialize(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "c1"), "back")
        found = materialize(colour.where("node = label").select("node", "label"), "found")
        while True:
            step = found.join(back, (F.col("node") == F.col("src")) & (F.col("label") == F.col("c1"))).select(F.col("dst").alias("node"), "label").distinct()
            new = materialize(_one_task(step.join(found, ["node", "label"], "left_anti"), n), "found")
            if new.isEmpty():
                break
            found = materialize(found.union(new), "found")
        done = done.union(found.select(F.col("node").alias("name"), F.col("label").alias("root")))
        todo = materialize(todo.join(found.select("node"), "node", "left_anti"), "todo")
        if todo.isEmpty():
            return done
        adj = materialize(_one_task(kept.join(todo.toDF("src"), "src", "left_semi").join(todo.toDF("dst"), "dst", "left_semi").select("src", "dst"), n), "adj")


def cycle_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, scc_id, root) of units in cycles: components of two or more, or a self-loop; ids follow the least member's name."""
    names = eligible(nodes)
    scc = strongly_connected(names, edges)
    loops = adjacency(edges, names).where("src = dst").select(F.col("src").alias("name"))
    roots = scc.groupBy("root").agg(F.count("*").alias("n")).join(loops.withColumn("loop", F.lit(True)).withColumnRenamed("name", "root"), "root", "left")
    # only cycles are numbered, a small part of the units
    ids = roots.where("n > 1 or loop").select("root", F.row_number().over(Window.orderBy("root")).alias("scc_id"))
    return scc.join(ids, "root").select("name", "scc_id", "root")


def internal_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in one component, per kind: (src, dst, edge_kind, scc_id)."""
    a = members.select(F.col("name").alias("src"), F.col("scc_id").alias("s1"))
    b = members.select(F.col("name").alias("dst"), F.col("scc_id").alias("s2"))
    return edges.join(a, "src").join(b, "dst").where("s1 = s2").select("src", "dst", "edge_kind", F.col("s1").alias("scc_id"))


def unit_scores(inner: DataFrame) -> DataFrame:
    """(name, score, scc_id): one for each end of each internal edge, so a self-loop counts twice."""
    return inner.select(F.explode(F.array("src", "dst")).alias("name"), "scc_id").groupBy("name", "scc_id").agg(F.count("*").alias("score"))


def hotspot_edges(inner: DataFrame) -> DataFrame:
    """(src, dst, edge_kind, scc_id, rank, hint): rank is the sum of both ends' scores; order by rank, kind, names."""
    s = unit_scores(inner).select("name", "score")
    out = inner.join(s.toDF("src", "r1"), "src").join(s.toDF("dst", "r2"), "dst")
    return out.select("src", "dst", "edge_kind", "scc_id", (F.col("r1") + F.col("r2")).alias("rank"), hotspot_hint(F.col("edge_kind")).alias("hint"))


def sort_hotspot_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy(F.desc("rank"), hotspot_rank_of_kind(F.col("edge_kind")), F.lower("src"), F.lower("dst"))


def sort_edges(edges: DataFrame) -> DataFrame:
    """By source and target, case-insensitive, then kind."""
    return edges.orderBy(F.lower("src"), F.lower("dst"), ordinal(F.col("edge_kind"), EDGE_KINDS))


def sort_components(members: DataFrame) -> DataFrame:
    """(scc_id, members, n) by size, largest first, then id."""
    return members.groupBy("scc_id").agg(F.array_sort(F.collect_list("name")).alias("members"), F.count("*").alias("n")).orderBy(F.desc("n"), "scc_id")


def sort_hotspot_units(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("score"), F.lower("name"))


def _first_cycle(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Depth-first with sorted neighbours from the least member back to it; the first path found."""
    out: dict[str, list[str]] = {}
    for s, d in sorted(set(zip(group["src"], group["dst"], strict=True)), key=lambda e: (e[0].lower(), e[1].lower(), e)):
        out.setdefault(s, []).append(d)
    root = group["root"].iloc[0]
    if root in out.get(root, []):
        path = [root, root]
        if len(set(group["src"]) | set(group["dst"])) == 1:
            return pd.DataFrame({"scc_id": [int(key[0])], "cycle": [" -> ".join(path)]})
    path, seen = [root], {root}
    stack = [iter(x for x in out.get(root, []) if x != root)]
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            path.pop()
        elif node == root:
            return pd.DataFrame({"scc_id": [int(key[0])], "cycle": [" -> ".join([*path, root])]})
        elif node not in seen:
            seen.add(node)
            path.append(node)
            stack.append(iter(out.get(node, [])))
    return pd.DataFrame({"scc_id": [int(key[0])], "cycle": [""]})


def representative_cycles(inner: DataFrame, members: DataFrame) -> DataFrame:
    """(scc_id, cycle): one cycle of each component as ``A -> B -> A``. A component is one program's units, so it fits a task."""
    roots = members.select("scc_id", "root").distinct()
    return inner.select("src", "dst", "scc_id").distinct().join(roots, "scc_id").groupBy("scc_id").applyInPandas(_first_cycle, "scc_id int, cycle string")


def focus(edges: DataFrame, members: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """Outgoing edges of a unit, and the cycles that hold it (by whole name)."""
    out = edges.where(F.lower("src") == unit.lower())
    of = members.groupBy("scc_id").agg(F.array_sort(F.collect_list("name")).alias("members"))
    return out, of.where(F.exists("members", lambda m: F.lower(m) == unit.lower()))


def graph_counts(nodes: DataFrame, edges: DataFrame, problems: DataFrame) -> DataFrame:
    """One row: nodes, resolved, unresolved, edges, problems."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("resolution_rank") == 0).alias("resolved"), F.count_if(F.col("resolution_rank") == 1).alias("unresolved"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(problems.agg(F.count("*").alias("problems")))
