"""The trie of all conversations' beginnings, encoded by preorder intervals.

A node is a distinct sequence of first turns. Its name is the exclusive-or, over its turns, of 128
bits that hang on a turn and its place, so that names are prefix sums and no conversation is ever
held whole. Childless nodes are ranked lexicographically by the turns at which their path leaves
another one; a path that passes K branchings shares the first of them with K other ways, so such a
key is at most as long as the root of twice the number of rows. A node's subtree is the interval
from its place in preorder to that of the last childless node below it, and its leaves and savings
are differences of prefix sums at the interval's ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialise, remainder
from .scan import running

SEED = 0x7E1E
#: Ids of one conversation end that are joined to one text at most, before texts are hashed in order.
END_IDS = 4096
NODE = ["depth", "h1", "h2"]


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 1), key (128 bits of role and text, in hex) and words of every turn.

    Turns are ordered by number (null first), then role and text, so that repeated rows and ties have
    a place each. A null role or text is empty; rows without a conv_id belong to no conversation."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    key = F.substring(F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256), 1, 32)
    rows = rows.withColumns({"key": key, "words": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), "one": F.lit(1).cast("long")})
    return running(rows, "conv_id", ["conv_id", "turn", "role", "text"], {"place": "one"}, drop=("turn", "role", "text"), what="turns").drop("one")


def with_shared_beginnings(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which conversation c begins with the first h turns of c - c % group,
    and its own turns follow after its own first h; h is crc32 of the decimal c, modulo `most`.

    turns: conv_id, place, n_turns, key, words. conversations: conv_id and n_turns, turnless ones too."""
    lengths = materialise(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")), "lengths")
    total = lengths.agg(F.sum("n_own")).first()[0] or 0
    convs = lengths.withColumns({"h": remainder("conv_id", most), "base": F.col("conv_id") - F.col("conv_id") % group})
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    shared = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.select("conv_id", "base", "h", "n_own", shared.alias("n_shared"), (shared + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"))
    convs = materialise(convs, "convs")
    own = join_by_key(turns, convs, ["conv_id"], "n_own", total).where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("n_shared"))
    first = turns.where((F.col("place") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "place", "key", "words")
    given = convs.select("conv_id", "base", "h", "n_turns").join(first, "base").where("place <= h")  # under 2 * group followers each
    columns = ["conv_id", "place", "n_turns", "key", "words"]
    return own.select(*columns).unionByName(given.select(*columns)), convs.select("conv_id", "n_turns")


def _runs_of_ids(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by node and conv_id -> one row for up to END_IDS ids of a node, joined by commas."""
    for pdf in parts:
        new = (pdf[NODE] != pdf[NODE].shift()).any(axis=1).to_numpy()
        run = new.cumsum()
        inside = pdf.groupby(run).cumcount() // END_IDS
        cut = pdf.assign(run=run, inside=inside.to_numpy(), ids=pdf["conv_id"].astype(str))
        yield cut.groupby(["run", "inside"], sort=False).agg(depth=("depth", "first"), h1=("h1", "first"), h2=("h2", "first"), first=("conv_id", "first"), ids=("ids", ",".join)).reset_index(drop=True)


def _hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by node and first id -> SHA-256 over all ids of each node, text after text."""
    node, state = None, None
    for pdf in parts:
        out = []
        for depth, h1, h2, ids in zip(pdf["depth"], pdf["h1"], pdf["h2"], pdf["ids"], strict=True):
            if (depth, h1, h2) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, h1, h2), hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """depth, h1, h2, ends_sha256 of every node at which conversations end. A node with very many is
    joined to texts in many tasks; one task only hashes these, a row for END_IDS conversations."""
    kind = "depth long, h1 long, h2 long"
    runs = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInPandas(_runs_of_ids, f"{kind}, first long, ids string")
    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInPandas(_hashed, f"{kind}, ends_sha256 string")


def _node(depth: Column, h1: Column, h2: Column) -> list[Column]:
    return [c.cast("long").alias(name) for name, c in zip(NODE, (depth, h1, h2), strict=True)]


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and first_place and last_place, its interval in preorder.

    `turns` has conv_id, place (from 1), n_turns, key and words, `convs` every conv_id and its n_turns.
    Without conversations there is no node; turnless ones are members of the root and end there. A
    conversation or a node that holds a large part of all rows is spread over tasks."""
    marks = turns.withColumns({"m1": F.xxhash64("key", "place"), "m2": F.xxhash64(F.lit(SEED), "place", "key")})
    rows = running(marks, "conv_id", ["conv_id", "place"], {}, {"h1": "m1", "h2": "m2"}, what="prefixes").withColumnRenamed("place", "depth")
    total = rows.count()

    above = [(F.col("depth") - 1).alias("above"), F.col("h1").bitwiseXOR(F.col("m1")).alias("a1"), F.col("h2").bitwiseXOR(F.col("m2")).alias("a2")]
    nodes = rows.select(*NODE, "conv_id", "words", *above).groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *(F.first(c).alias(c) for c in ("words", "above", "a1", "a2")),
    )
    none = F.lit(None).cast("long")
    root = convs.groupBy(*_node(F.lit(0), F.lit(0), F.lit(0))).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("words"), none.alias("above"), none.alias("a1"), none.alias("a2"))
    nodes = materialise(nodes.unionByName(root), "nodes")
    n_nodes = nodes.count()
    children = nodes.where("depth > 0").groupBy(*_node(F.col("above"), F.col("a1"), F.col("a2"))).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("above"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    below = join_by_key(nodes.where("depth > 0"), parents, ["above", "a1", "a2"], "siblings", n_nodes)
    top = nodes.where("depth = 0").withColumns({"parent_conv_id": none, "siblings": F.lit(1).cast("long")})
    nodes = materialise(below.unionByName(top).drop("above", "a1", "a2"), "nodes")

    # Lexicographic rank of the childless nodes, by the turns at which their paths branch off.
    branches = nodes.where("siblings > 1").select(*NODE, "n_convs")
    turned = join_by_key(rows.select("conv_id", *NODE, "key"), branches, NODE, "n_convs", total)
    way = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "key"))), lambda x: x["key"]), "")
    ways = turned.groupBy("conv_id").agg(way.alias("way"))
    leaves = nodes.where("n_children = 0").select("conv_id", F.col("depth").alias("n"), F.lit(1).cast("long").alias("one")).join(ways, "conv_id", "left").withColumn("way", F.coalesce("way", F.lit("")))
    leaves = running(leaves, None, ["way"], {"leaf": "one"}, drop=("way",), what="leaves")

    # Every node lies on the way to a childless one: its first and last are where its interval ends.
    spans = join_by_key(rows.select("conv_id", *NODE), leaves.select("conv_id", "leaf", "n"), ["conv_id"], "n", total)
    spans = spans.groupBy(*NODE).agg(F.min("leaf").alias("first_leaf"), F.max("leaf").alias("last_leaf"))
    whole = leaves.groupBy(*_node(F.lit(0), F.lit(0), F.lit(0))).agg(F.min("leaf").alias("first_leaf"), F.max("leaf").alias("last_leaf"))
    placed = nodes.join(spans.unionByName(whole), NODE).withColumns({
        "one": F.lit(1).cast("long"), "is_leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("words"),
    })
    placed = running(placed, None, ["first_leaf", "depth"], {"first_place": "one", "leaves": "is_leaf", "saved": "saving"}, what="preorder")
    many = placed.groupBy("last_leaf").agg(F.count(F.lit(1)).alias("n_ending"))
    ends = placed.where("is_leaf = 1").select("last_leaf", F.col("first_place").alias("last_place"), F.col("leaves").alias("leaves_end"), F.col("saved").alias("saved_end")).join(many, "last_leaf")
    out = join_by_key(placed, ends, ["last_leaf"], "n_ending", n_nodes)

    ending = rows.where("depth = n_turns").select(*NODE, "conv_id").unionByName(convs.where("n_turns = 0").select(*_node(F.lit(0), F.lit(0), F.lit(0)), "conv_id"))
    out = out.join(_ends(ending), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_end") - F.col("leaves") + F.col("is_leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved") + F.col("saving")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "first_place", "last_place",
    )
