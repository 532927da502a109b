"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits unit vectors by random directions at medians, level by level; its depth follows the
number of vectors, so that leaves keep their size as the table grows. A vector near a split goes
down both sides, so that neighbours hardly ever part; how near follows from the dimension, as the
distance of two neighbours along a random direction shrinks with its root. Medians are fitted on a
bounded sample: nodes with enough of it have their own, deeper ones take their level's. Every vector
is routed through every tree. Vectors of one leaf and label are compared by cosine in double
precision. A leaf of more than `BLOCK` vectors is cut into blocks and all pairs of its blocks are
compared in tasks of their own, which is exact whatever a leaf's size.

No table of pairs is made: a task counts a pair only if it is the pair's first common leaf, which
both vectors' ways through the trees tell, and hands on, for each vector, the number of its new
links and one link to its component within the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_by_key, materialise
from .components import connected_components

TREES = 5
#: Distinct vectors that the medians are fitted on at about (twice as many at most), those of them that a
#: node of its own median needs, and vectors of one label in a leaf at about.
SAMPLE, NODE_SAMPLE, LEAF = 20_000, 24, 32
#: Vectors nearer to a split than this share of a neighbour's usual distance go down both sides.
SPILL = 0.4
BLOCK = 2048
#: Rows that one call of the comparison gets at about.
BOX = 8192
COSINE = 0.98
SEED = 0xF0E57


class Forest:
    """Directions and medians of all trees, for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        dim = sample.shape[1]
        self.depth = depth
        # The usual distance: that of two unit vectors at the threshold along a random direction.
        self.spill = SPILL * np.sqrt(2 * (1 - COSINE) / max(dim, 1))
        rng = np.random.default_rng([SEED, dim])
        self.directions = rng.standard_normal((TREES, depth, dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.fitted = min(depth, max(0, int(np.log2(max(1, len(sample)) / NODE_SAMPLE))))
        self.medians = np.zeros((TREES, max(1, (1 << self.fitted) - 1)))
        self.of_level = np.zeros((TREES, depth))
        for tree in range(TREES if len(sample) else 0):
            node = np.zeros(len(sample), dtype=np.int64)
            for level in range(depth):
                along = sample @ self.directions[tree, level]
                self.of_level[tree, level] = np.median(along)
                if level < self.fitted:
                    order = np.argsort(node, kind="stable")
                    starts = np.flatnonzero(np.diff(node[order], prepend=-1))
                    for own in np.split(order, starts[1:]):
                        self.medians[tree, (1 << level) - 1 + node[own[0]]] = np.median(along[own])
                    node = 2 * node + (along > self._median(tree, level, node))

    def _median(self, tree: int, level: int, node: np.ndarray) -> np.ndarray | float:
        return self.medians[tree, (1 << level) - 1 + node] if level < self.fitted else self.of_level[tree, level]

    def leaves(self, vectors: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that the rows reach; a row comes more than once where it spills."""
        row, node = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64)
        for level in range(self.depth):
            off = (vectors @ self.directions[tree, level])[row] - self._median(tree, level, node)
            left, right = off <= self.spill, off > -self.spill
            row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
        return row, node

    def met_before(self, vectors: np.ndarray, tree: int, leaf: int) -> np.ndarray:
        """Which pairs of the vectors share a leaf of an earlier tree, or one before `leaf` in this."""
        met = np.zeros((len(vectors), len(vectors)), dtype=bool)
        for t in range(tree + 1):
            row, at = self.leaves(vectors, t)
            if t == tree:
                row, at = row[at < leaf], at[at < leaf]
            _, number = np.unique(at, return_inverse=True)
            inside = np.zeros((len(vectors), int(number.max(initial=-1)) + 1), dtype=np.float32)
            inside[row, number] = 1
            met |= inside @ inside.T > 0
        return met


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return _unit(np.array(column.tolist(), dtype=np.float64))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _routed(forests: dict[int, Forest]):
    def job(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for dim, own in pdf.groupby("dim"):
                unit = _matrix(own["vector"])
                for tree in range(TREES):
                    row, leaf = forests[dim].leaves(unit, tree)
                    yield pd.DataFrame({"tree": tree, "leaf": leaf, "label": own["label"].to_numpy()[row], "dim": dim, "id": own["id"].to_numpy()[row]})

    return job


def linked_rows(unit: np.ndarray, left: np.ndarray, right: np.ndarray, forest: Forest, tree: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of rows with cosine >= COSINE whose first common leaf this is, each pair once.
    `left` rows meet `right` ones; if both are the same rows, all of these meet."""
    found = []
    for at in range(0, len(left), 512):
        i, j = np.nonzero(unit[left[at : at + 512]] @ unit[right].T >= COSINE - 1e-9)
        x, y = left[at + i], right[j]
        near = x < y if left is right else x != y
        x, y = x[near], y[near]
        near = (unit[x] * unit[y]).sum(axis=1) >= COSINE
        found.append(np.stack((x[near], y[near])))
    x, y = np.concatenate([np.empty((2, 0), np.int64), *found], axis=1)
    if len(x):
        rows, number = np.unique(np.concatenate((x, y)), return_inverse=True)
        new = ~forest.met_before(unit[rows], tree, leaf)[number[: len(x)], number[len(x) :]]
        x, y = x[new], y[new]
    return x, y


def _components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches by pairs (x, y)."""
    top = np.arange(n)
    while True:
        before = top.copy()
        least = np.minimum(top[x], top[y])
        np.minimum.at(top, x, least)
        np.minimum.at(top, y, least)
        np.minimum.at(top, before, top.copy())
        top = top[top]
        if (top == before).all():
            return top


def _compare(forests: dict[int, Forest]):
    """(id, near, rep, root) of vectors with new links in the tasks of a table: how many vectors they
    link with, and the representatives of their class and of one in their component. Rows of block
    `i` (side 0) meet those of block `j` (side 1); in a task of one block (side -1) all of them meet."""

    def job(table: pa.Table) -> pa.Table:
        ids, side, task, tree, leaf, dim, copies, rep = (table.column(c).to_numpy() for c in ("id", "side", "task", "tree", "leaf", "dim", "copies", "rep"))
        vectors = table.column("vector").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        values, start = vectors.flatten().to_numpy(), vectors.offsets.to_numpy()[:-1] - vectors.offsets[0].as_py()
        order = np.lexsort((task, leaf, tree))
        new = np.ones(len(order) + 1, dtype=bool)
        new[1:-1] = (np.diff(task[order]) != 0) | (np.diff(leaf[order]) != 0) | (np.diff(tree[order]) != 0)
        bounds, out = np.flatnonzero(new), [np.empty((4, 0), dtype=np.int64)]
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            rows = order[first:last]
            one = rows[0]
            unit = _unit(values[start[rows][:, None] + np.arange(dim[one])])  # a task has one dimension
            left = right = np.arange(len(rows))
            if side[one] != -1:
                left, right = np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == 1)
            x, y = linked_rows(unit, left, right, forests[dim[one]], int(tree[one]), int(leaf[one]))
            near = np.zeros(len(rows), dtype=np.int64)
            np.add.at(near, x, copies[rows[y]])
            np.add.at(near, y, copies[rows[x]])
            top, linked = _components(len(rows), x, y), near > 0
            out.append(np.stack((ids[rows[linked]], near[linked], rep[rows[linked]], rep[rows[top[linked]]])))
        return pa.table(dict(zip(("id", "near", "rep", "root"), np.concatenate(out, axis=1), strict=True)))

    return job


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null labels and equal length are compared. Null and zero vectors and
    those with null or non-finite components link with nothing, nor do rows of a null id. Equal
    vectors are one class: they link with each other and with all that one of them links with. Rows
    that repeat id, vector and label count as one vector; rows that share only the id bring their
    links to it together. Vectors may have any length; a component is named by its smallest id, so
    there are no ties. An empty table gives no rows; other columns are ignored."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))).distinct()
    # 128 bits name a class until it has a number.
    good = good.withColumns({"k1": F.xxhash64("label", "vector"), "k2": F.xxhash64(F.lit(SEED), "vector", "label"), "dim": F.size("vector")})
    good = materialise(good, "vectors")
    classes = good.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.first("dim").alias("dim"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    forests: dict[int, Forest] = {}
    counts = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    for dim, count, most in counts.collect():  # as many rows as there are lengths
        share = min(1.0, SAMPLE / count)
        part = classes.where((F.col("dim") == dim) & (F.pmod(F.col("k2"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("vector").limit(2 * SAMPLE).toPandas()
        forests[dim] = Forest(_matrix(part["vector"]) if len(part) else np.zeros((0, dim)), max(0, int(np.ceil(np.log2(most / LEAF)))))
    shared = spark.sparkContext.broadcast(forests)  # TREES * SAMPLE / NODE_SAMPLE medians and few directions

    plain = classes.select("id", "label", "dim", "vector")
    routed = plain.mapInPandas(lambda parts: _routed(shared.value)(parts), f"tree int, leaf long, label {dict(plain.dtypes)['label']}, dim int, id long")
    routed = materialise(routed, "leaves")
    place = ["tree", "leaf", "label", "dim"]
    sizes = materialise(routed.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = join_by_key(routed, sizes, place, "n", total).withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("id", "tree"), F.col("blocks")))
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = tasks.select(
        F.xxhash64(*place, F.least("own", "other"), F.greatest("own", "other")).alias("task"), "id", "tree", "leaf",
        F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    tasks = tasks.join(classes.select("id", "dim", "vector", "copies", "rep"), "id")
    box = F.pmod(F.xxhash64("task"), F.lit(max(1, -(-total // BOX))))
    found = tasks.groupBy(box.alias("box")).applyInArrow(lambda t: _compare(shared.value)(t), "id long, near long, rep long, root long")
    found = materialise(found, "found")
    discard(routed, sizes)

    # Rows that share only the id join their classes.
    names = classes.select("k1", "k2", "copies", "rep")
    n_good = good.count()
    repeated = good.groupBy("vec_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    mine = join_by_key(good.join(repeated, "vec_id", "left_semi").select("vec_id", "k1", "k2"), names, ["k1", "k2"], "copies", n_good)
    mine = mine.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    parts = connected_components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct().unionByName(mine))

    # Back from classes to vectors.
    near = found.groupBy("id").agg(F.sum("near").alias("near"))
    known = classes.select("k1", "k2", "id", "copies", "rep").join(near, "id", "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = materialise(known.select("k1", "k2", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"), F.coalesce("component_id", "rep").alias("top")), "known")
    per_vector = join_by_key(good.select("vec_id", "k1", "k2"), known, ["k1", "k2"], "copies", n_good).groupBy("vec_id").agg(F.sum("links").alias("n_links"), F.min("top").alias("component_id"))
    out = rows.select("vec_id").join(per_vector, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
