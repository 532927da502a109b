"""Greedy choice over a conflict graph, settled component by component.

Edges that share no end, directly or through others, never decide about each other, so every
component can be settled by itself: its edges are visited in order inside one task, which keeps the
ends that are taken and nothing else. Components are found by contraction: each task joins the links
it holds and hands on the one representative of each node, until what is left fits one task. Only a
component of more than `GIANT` edges is first broken up by rounds that take all edges which come
first at all of their ends at once; that choice is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, drop_kept, kept

#: Links that one task joins, edges of a component that one task settles, and rounds before a giant
#: component is looked at again.
ONE_TASK, GIANT, ROUNDS = 2_000_000, 5_000_000, 3


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of the nodes of all links (a, b) of a task; the root is the least node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for pdf in parts:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pd.DataFrame({"node": nodes, "root": [root(x) for x in nodes]}, dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a and b, long): the least node that it reaches.

    A node with very many links costs no more than its links; every round deals them anew and leaves
    the roots of nodes that several tasks have, so few rounds are left however long the chains are."""
    steps, at = [], 0
    while True:
        few = links.count() <= ONE_TASK
        dealt = links.coalesce(1) if few else links.repartition(F.xxhash64(F.lit(at), F.least("a", "b")))
        found = checkpointed(dealt.mapInPandas(_contract, "node long, root long"))
        tops = found.groupBy("node").agg(F.min("root").alias("component"))
        steps.append(tops)
        if few:
            break
        links = checkpointed(found.join(tops, "node").where("root != component").select(F.col("root").alias("a"), F.col("component").alias("b")).distinct())
        at += 1
        if links.isEmpty():
            break
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("_at"), F.col("component").alias("_to")), F.col("component") == F.col("_at"), "left")
        out = out.select("node", F.coalesce("_to", "component").alias("component"))
    return out


def _visit(ends: list[str]):
    def job(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: set[int] = set()
        for pdf in parts:
            chosen = []
            for edge, *points in zip(pdf["_edge"].tolist(), *(pdf[c].tolist() for c in ends), strict=True):
                if taken.isdisjoint(points):
                    taken.update(points)
                    chosen.append(edge)
            yield pd.DataFrame({"_edge": chosen}, dtype="int64")

    return job


def settled(edges: DataFrame, ends: list[str], order: list[str]) -> DataFrame:
    """The edges that a sequential greedy choice in the total order `order` takes, each taking its end
    points (`ends`, long columns; one number is one point, whichever column it stands in).

    Points of one edge are distinct; without edges there is nothing to take. The number of jobs
    doesn't hang on the shape of the graph unless a component has more than GIANT edges."""
    spark, before = edges.sparkSession, kept(edges.sparkSession)
    edges = checkpointed(edges.withColumn("_edge", F.monotonically_increasing_id()))
    links = edges.select(F.explode(F.array(*(F.struct(F.col(ends[0]).alias("a"), F.col(c).alias("b")) for c in ends[1:]))).alias("x")).select("x.a", "x.b")
    own = components(links).withColumnRenamed("node", ends[0])
    keyed = edges.select("_edge", *ends, *(c for c in order if c not in ends)).join(own, ends[0])
    giant = None
    if edges.count() > GIANT:
        large = keyed.groupBy("component").count().where(F.col("count") > GIANT).select("component")  # fewer than edges / GIANT
        keyed = checkpointed(keyed)
        giant = keyed.join(F.broadcast(large), "component", "left_semi")
        keyed = keyed.join(F.broadcast(large), "component", "left_anti")
    visited = keyed.repartition("component").sortWithinPartitions(*order).mapInPandas(_visit(ends), "_edge long")
    if giant is not None and not giant.isEmpty():
        first, rest = rounds(giant.drop("component"), ends, order)
        visited = visited.unionByName(first.select("_edge")).unionByName(settled(rest.withColumnRenamed("_edge", "_outer"), ends, order).select(F.col("_outer").alias("_edge")))
    out = checkpointed(edges.join(visited, "_edge", "left_semi").drop("_edge"))
    drop_kept(spark, before, out)
    return out


def rounds(edges: DataFrame, ends: list[str], order: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges taken, edges left) after `most` rounds (ROUNDS if not given), each of which takes the
    edges that come first at all of their ends and drops those that touch them."""
    left = checkpointed(edges.withColumn("_order", F.struct(*order)))
    taken = left.limit(0)
    for _ in range(ROUNDS if most is None else most):
        points = left.select(F.explode(F.array(*ends)).alias("point"), "_order")
        first = points.groupBy("point").agg(F.min("_order").alias("_first"))
        ranked = left
        for i, end in enumerate(ends):
            ranked = ranked.join(first.select(F.col("point").alias(end), F.col("_first").alias(f"_first_{i}")), end)
        local = F.lit(True)
        for i in range(len(ends)):
            local = local & (F.col("_order") == F.col(f"_first_{i}"))
        chosen = checkpointed(ranked.where(local).select(*left.columns))
        taken = taken.unionByName(chosen)
        gone = chosen.select(F.explode(F.array(*ends)).alias("point"))
        for end in ends:
            left = left.join(gone.select(F.col("point").alias(end)), end, "left_anti")
        left = checkpointed(left.select(*chosen.columns))
        if left.isEmpty():
            break
    return taken.drop("_order"), left.drop("_order")
