"""Graphs: communities, components, merged hierarchies. Edges are (source, target, weight)."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import checkpointed

#: Edges that modularity is computed over at most; a larger graph gets its connected components.
MAX_EDGES = 10_000


def modularity(edges: list[tuple[str, str, float]], group: dict[str, int]) -> float:
    total = sum(w for *_, w in edges) or 1.0
    inside, strength = {}, {}
    for a, b, w in edges:
        strength[group[a]] = strength.get(group[a], 0.0) + w
        strength[group[b]] = strength.get(group[b], 0.0) + w
        if group[a] == group[b]:
            inside[group[a]] = inside.get(group[a], 0.0) + w
    return sum(inside.get(g, 0.0) / total - (s / (2 * total)) ** 2 for g, s in strength.items())


def greedy_communities(edges: list[tuple[str, str, float]]) -> dict[str, int]:
    """Merge the two communities whose union gains most modularity until no union gains; numbered by size, then first name."""
    total = sum(w for *_, w in edges)
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    number = {n: i for i, n in enumerate(nodes)}
    members = {i: [n] for n, i in number.items()}
    between: dict[int, dict[int, float]] = {i: {} for i in members}
    share = dict.fromkeys(members, 0.0)
    for a, b, w in edges:
        i, j = number[a], number[b]
        share[i] += w / (2 * total)
        share[j] += w / (2 * total)
        if i != j:
            between[i][j] = between[i].get(j, 0.0) + w / total
            between[j][i] = between[j].get(i, 0.0) + w / total
    gain = lambda i, j: between[i][j] - 2 * share[i] * share[j]
    queue = [(-gain(i, j), i, j) for i in between for j in between[i] if i < j]
    heapq.heapify(queue)
    while queue:
        g, i, j = heapq.heappop(queue)
        if i not in members or j not in members or j not in between[i] or -g != gain(i, j):
            continue  # of communities that have changed since
        if g >= 0:
            break
        members[i] += members.pop(j)
        for k, w in between.pop(j).items():
            if k != i:
                between[k].pop(j)
                between[i][k] = between[k][i] = between[i].get(k, 0.0) + w
        between[i].pop(j, None)
        share[i] += share.pop(j)
        for k in between[i]:
            a, b = min(i, k), max(i, k)
            heapq.heappush(queue, (-gain(a, b), a, b))
    ordered = sorted((sorted(m) for m in members.values()), key=lambda m: (-len(m), m[0]))
    return {n: c for c, m in enumerate(ordered, 1) for n in m}


def communities(edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """``term``, ``cluster`` and ``method``: ``modularity`` (greedy), or ``components`` for a table of more than ``max_edges``
    edges, which is not gathered into one task but gets its connected components."""
    if edges.limit(max_edges + 1).count() > max_edges:
        found = connected(edges)
        sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        numbered = sizes.select("component", F.row_number().over(Window.orderBy(F.desc("n"), "component")).alias("cluster"))
        return found.join(numbered, "component").select(F.col("node").alias("term"), "cluster", F.lit("components").alias("method"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        found = greedy_communities([(a, b, float(w)) for a, b, w in group[["source", "target", "weight"]].itertuples(index=False)])
        return pd.DataFrame(sorted(found.items()), columns=["term", "cluster"])

    found = edges.select("source", "target", "weight", F.lit(0).alias("all")).groupBy("all").applyInPandas(one, "term string, cluster int")
    return found.select("term", "cluster", F.lit("modularity").alias("method"))


def star_forest(edges: DataFrame, write: Callable[[DataFrame, str], DataFrame], drop: Callable[..., None] = lambda *_: None) -> DataFrame:
    """Each node that has an edge (columns ``u``, ``v``) and the smallest node reachable from it: ``node``, ``component``.

    Rounds alternate between two steps over edges that point from a larger node to a smaller one: every edge's smaller end
    goes on to its own smallest neighbour, then each node's smaller neighbours are tied to the least of them. The graph is
    settled when each node has one smaller neighbour that has none itself. Each round lowers an end of some edge, so the loop
    ends by itself; paths, rings and random graphs take about as many rounds as their length has binary digits. Aggregations
    combine before the shuffle and the joins are plain ones that adaptive execution may split, so a hub with a third of all
    edges does not land in one task. ``write`` makes a table that cuts lineage; nothing goes to the driver but counts.
    """
    now = write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    while True:
        least = write(now.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        above = least.select(F.col("u").alias("v"), F.col("m").alias("up"))
        raised = write(now.join(above, "v", "left").select("u", F.coalesce("up", "v").alias("v"), F.col("up").isNotNull().alias("moved")), "raised")
        if not least.where("n > 1").limit(1).count() and not raised.where("moved").limit(1).count():
            break
        lower = write(raised.groupBy("u").agg(F.min("v").alias("m")), "lower")
        tied = raised.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        following = write(tied.distinct(), "edges")
        drop(now, least, raised, lower)
        now = following
    drop(least, raised)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest name reachable). Each step is checkpointed, so lost executors cost one step;
    a node that has an edge to itself alone is its own component."""
    pairs = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    found = star_forest(pairs, lambda df, _: checkpointed(df))
    alone = pairs.where("u = v").select(F.col("u").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))


def connected_sql() -> str:
    """Components as recursive SQL over a view ``edges`` (small graphs)."""
    return "WITH RECURSIVE b AS (SELECT source a, target b FROM edges UNION SELECT target, source FROM edges), reach(node, seen) AS (SELECT DISTINCT a, a FROM b UNION SELECT r.node, b.b FROM reach r JOIN b ON r.seen = b.a) SELECT node, min(seen) AS component FROM reach GROUP BY node"
