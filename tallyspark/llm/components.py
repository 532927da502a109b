"""Connected components of a link table, by alternating large and small stars.

Links stay a distributed table throughout. Each round points every node at the smallest node it
knows of, first for neighbours above a node, then for those below; rounds end when nothing changes.
Before the rounds each task contracts the links it happens to hold, which settles most of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_by_key, materialise


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one batch of links at a time: (node, smallest node) of each of its components."""
    for pdf in parts:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        tops = [root(x) for x in nodes]
        yield pd.DataFrame({"u": nodes, "v": tops}, dtype="int64").query("u != v")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component_id) for every node of `links` (columns a and b, not null); component_id is
    the smallest node reachable. Links of a node with itself and repeated links do no harm. A node
    with very many links is a hot key and is joined by broadcast."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = edges.where("u != v").mapInPandas(_contract, "u long, v long").distinct()
    edges, mark = _fixed(edges)
    while mark:
        total = 2 * mark[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = join_by_key(both, least, ["u"], "degree", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))  # few smaller nodes are left for each node
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        before = edges
        edges, now = _fixed(small)
        discard(before)
        if now == mark:
            break
        mark = now
    tops = edges.select(F.col("u").alias("node"), F.col("v").alias("_top"))
    return nodes.join(tops, "node", "left").select("node", F.coalesce("_top", "node").alias("component_id"))


def _fixed(edges: DataFrame) -> tuple[DataFrame, tuple[int, int] | None]:
    """The links as a stage table, and their number and a sum over them to see whether they change."""
    edges = materialise(edges, "links")
    n, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return edges, (n, int(total)) if n else None
