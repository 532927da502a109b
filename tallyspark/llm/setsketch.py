"""Near-duplicate texts by SetSketch registers.

Each distinct shingle set gets `REGISTERS` registers: exponentially spaced, truncated minima of
exponential hash values, so that sketches merge by maximum and equal registers grow likelier with
similarity. Runs of `ROWS` registers are band keys. Texts of a band meet in two rounds:

1. every member is compared with its band's smallest id; confirmed links give first components;
2. members of one band that are not yet in one component are compared with each other.

So a large group of copies costs one comparison for each member and band, not one for each pair,
and no link between components is lost. Members of a band that no link joins to its main component meet
each other in blocks, so that a band costs the square of their number: such bands hold texts that
share five registers though they are not similar, which are few, or chains of texts. A pair is first judged by the sketches alone: the
similarity is estimated by maximum likelihood from the counts of greater, equal and smaller
registers and the known set sizes, and far pairs go. All others are confirmed on their full sets.
Both rounds do that inside tasks: the texts of those that have a likely partner come there, become full
sets there, and for each member one link to its component within the task is handed on. Texts are half
as large as their hashes in a shuffle, and no table of full sets is ever made. The second round finds its
likely partners inside its tasks too, so it makes no table of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, join_by_key, materialise, runs, sieved, word_hashes
from .components import connected_components

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Spacing of register values, and what is added so that they are positive.
SPACING, SHIFT, TOP = 1.004, 12000, 65535
#: An estimate may fall short of the threshold by this much; at 200 registers that is over six
#: standard errors at similarity 0.8.
SLACK = 0.18
#: Members of a band that are compared in one task, and rows that one call gets at about.
TASK, BOX = 512, 8192
#: Partners of a text that its full set meets in one task.
SALTED = 1024
#: Shingles that one call of the confirmation gets at about, and bytes of text that one step makes into sets.
BOX_SHINGLES, STEP_BYTES = 500_000, 1 << 18
SHINGLE_WORDS, SIMILARITY = 5, 80

_FACTORS = np.random.default_rng(0x5E75).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHINGLED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.binary())])


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct k-word shingles, A-Z lower-cased. A text of fewer
    than k words is one shingle; one without words has none."""
    words, first = word_hashes(texts, lower=True)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(runs(words[a:b], min(k, b - a))) if b > a else np.empty(0, np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _FACTORS).min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 1.0) / 2.0**64 * (1 - 2.0**-53))
    return np.clip(np.floor(1 - np.log(exponential) / np.log(SPACING)) + SHIFT, 0, TOP).astype("<u2")


def register_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greater, smaller and equal registers of pairs of sketches (rows of a and b)."""
    over, under = (a > b).sum(axis=1), (a < b).sum(axis=1)
    return over, under, a.shape[1] - over - under


def _likelihood(j: np.ndarray | float, counts: tuple[np.ndarray, np.ndarray, np.ndarray], u: np.ndarray) -> np.ndarray:
    """Log likelihood of a similarity; u is the first set's share of both sizes."""

    def share(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (SPACING - 1) / SPACING) / np.log(SPACING)

    p, q, tiny = share(u - (1 - u) * j), share(1 - u - u * j), 1e-12
    return counts[0] * np.log(p + tiny) + counts[1] * np.log(q + tiny) + counts[2] * np.log(np.maximum(1 - p - q, tiny))


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum likelihood estimate of the Jaccard similarity of pairs of sketches (rows of a and b)."""
    counts, u = register_counts(a, b), size_a / (size_a + size_b)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(40):  # the likelihood is concave: narrow down from both sides
        x, y = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = _likelihood(x, counts, u) > _likelihood(y, counts, u)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def estimated_above(least: float, counts: tuple[np.ndarray, np.ndarray, np.ndarray], size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether `similarity` is `least` or more: as the likelihood is concave, where it still rises there."""
    u = size_a / (size_a + size_b)
    return _likelihood(least + 1e-5, counts, u) > _likelihood(least - 1e-5, counts, u)


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set) and sketch; both null for an empty set."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sketches = [], [], []
            for _, texts in chunks(batch.column(1), STEP_BYTES):
                for found in shingle_sets(texts, k):
                    sizes.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    sketches.append(registers(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], schema=SHINGLED)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        job, "doc_id long, n_shingles long, set_key binary, sketch binary"
    )


def _estimated(least: float):
    def job(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), dtype="<u2").reshape(len(pdf), REGISTERS) for c in ("sketch_a", "sketch_b"))
                yield pdf.loc[estimated_above(least, register_counts(a, b), pdf["n_a"].to_numpy(float), pdf["n_b"].to_numpy(float)), ["task", "a", "b", "n_a", "n_b"]]

    return job


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = SIMILARITY
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * intersection >= percent * union of their distinct shingles; a
    component is all that links reach, named by its smallest id, which is the one kept. Null, empty
    and blank texts have no shingles and link with nothing. Rows of a null id get component_id null
    and kept true, and link nothing. Rows that repeat an id are one document if their texts have
    equal sets, else their components are joined, since links are between ids. Texts are read whole,
    however long. An empty table gives no rows; other columns are ignored."""
    rows = materialise(sketched(docs, id_col, text_col, shingle_words), "sketches")
    known = rows.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    # Rows of one set have one sketch and one size, so any of them is the representative's.
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "classes")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    member = materialise(join_by_key(known.select("set_key", "doc_id"), classes.select("set_key", "rep", "copies"), ["set_key"], "copies", total), "members")
    reps = classes.select(F.col("rep").alias("id"), "n", "sketch")

    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("sketch", i * 2 * ROWS + 1, F.lit(2 * ROWS)))).alias("band", "part")
    keyed = reps.select("id", "n", bands).select(F.xxhash64("band", "part").alias("key"), "band", "id", "n")
    heads = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    heads = materialise(heads, "heads")
    total = heads.agg(F.sum("size")).first()[0] or 0
    keyed = materialise(join_by_key(sieved(keyed, "key", heads, "key"), heads, ["key"], "size", total).select("key", "band", "id", "n", "head"), "bands")
    close = f"a != b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"

    stars = keyed.select(F.col("head.id").alias("a"), F.col("id").alias("b"), F.col("head.n").alias("n_a"), F.col("n").alias("n_b"))
    stars = materialise(stars.where(close).distinct(), "stars")
    # A head may have very many partners, so it brings its sketch as a hot key does.
    degree = stars.groupBy("a").agg(F.count(F.lit(1)).alias("degree")).join(sieved(reps, "id", stars, "a").select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    degree = materialise(degree, "star_heads")
    likely = join_by_key(stars, degree, ["a"], "degree", stars.count()).join(sieved(reps, "id", stars, "b").select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    task = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / SALTED))).alias("task")
    likely = likely.select(task, "a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInPandas(_estimated(percent / 100 - SLACK), "task long, a long, b long, n_a long, n_b long")
    likely = materialise(likely.distinct(), "likely")
    ends = [likely.select("task", F.lit(side).alias("side"), F.col(c).alias("id"), F.col(f"n_{c}").alias("n"), F.col(c).alias("part")) for side, c in enumerate("ab")]
    links = materialise(_linked_members(ends[0].distinct().unionByName(ends[1]), docs, id_col, text_col, shingle_words, percent), "star_links")
    parts = materialise(connected_components(links), "parts")
    discard(heads, stars, degree, likely, links)

    open_ = materialise(_likely_members(keyed.select("key", "band", "id", "n"), parts, reps, percent), "likely_members")
    discard(keyed, classes)
    more = materialise(_linked_members(open_, docs, id_col, text_col, shingle_words, percent), "cross_links")
    discard(open_)

    # A class joins its members, links join classes, and rows that share an id join theirs.
    shared = member.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select(F.col("low").alias("a"), F.col("high").alias("b"))
    found = connected_components(parts.toDF("a", "b").unionByName(more).unionByName(shared))
    # Of each representative its component; a text with very many copies is a hot key here as well.
    tops = member.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).join(found, F.col("rep") == F.col("node"), "left")
    tops = materialise(tops.select("rep", "copies", F.coalesce("component_id", "rep").alias("component_id")), "tops")
    at = join_by_key(member, tops.withColumnRenamed("copies", "weight"), ["rep"], "weight", member.count()).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(at, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _likely_members(keyed: DataFrame, parts: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(task, side, id, n, part) of members of a band that have a partner there, of another component
    so far, which the sketches do not rule out. A pair counts in the first band that it shares.

    In each band the largest component's members need only meet the others, not each other, so the
    work grows with the band's size times the number of others. A band of more than `TASK` members is
    cut into blocks of both kinds, and pairs of blocks are compared in tasks of their own. Sketches are
    compared inside the tasks; only likely pairs leave them."""
    grouped = keyed.join(parts, F.col("id") == F.col("node"), "left").select("key", "band", "id", "n", F.coalesce("component_id", "id").alias("part"))
    grouped = materialise(grouped, "grouped")
    counts = grouped.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
    mixed = counts.groupBy("key").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.max("size").alias("n_main"), F.sum("size").alias("n_all")).where("n_all > n_main")
    mixed = materialise(mixed, "mixed")
    all_ = mixed.agg(F.sum("n_all")).first()[0] or 0
    members = materialise(join_by_key(sieved(grouped, "key", mixed, "key"), mixed, ["key"], "n_all", all_), "open")
    members = materialise(members.join(sieved(reps, "id", members, "id").select("id", "sketch"), "id"), "open_sketches")
    discard(grouped, mixed)
    total = members.count()
    inner, whole = F.col("part") == F.col("main"), F.col("n_all") <= TASK
    main_blocks, other_blocks = F.ceil(F.col("n_main") / TASK), F.ceil((F.col("n_all") - F.col("n_main")) / TASK)
    own = F.pmod(F.xxhash64("id"), F.when(inner, main_blocks).otherwise(other_blocks))
    # Tasks of a member: (left block, right block, side); blocks of the main component count from -1 down.
    task = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("int").alias("side"))
    zero = F.lit(0)
    with_others = F.transform(F.sequence(zero, other_blocks - 1), lambda j: task(-1 - F.col("own"), j, zero))
    with_main = F.transform(F.sequence(zero, main_blocks - 1), lambda i: task(-1 - i, F.col("own"), F.lit(1)))
    among = F.transform(F.sequence(zero, other_blocks - 1), lambda j: task(F.least("own", j), F.greatest("own", j), F.when(F.col("own") == j, -1).when(F.col("own") < j, 0).otherwise(1)))
    tasks = F.when(whole, F.array(task(zero, zero, F.lit(-1)))).when(inner, with_others).otherwise(F.concat(with_main, among))
    dealt = members.withColumn("own", own).withColumn("t", F.explode(tasks)).select(F.xxhash64("key", "t.i", "t.j").alias("task"), "t.side", "band", "id", "n", "part", "sketch")
    box = F.pmod(F.xxhash64("task"), F.lit(max(1, -(-total // BOX))))
    return dealt.groupBy(box.alias("box")).applyInArrow(_compared(percent), "task long, side int, id long, n long, part long")


def _task_rows(task: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each task in turn."""
    order = np.argsort(task, kind="stable")
    bounds = np.flatnonzero(np.diff(task[order], prepend=task[order[0]] - 1, append=task[order[-1]] + 1)) if len(order) else []
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        yield order[start:end]


def _compared(percent: int):
    def job(table: pa.Table) -> pa.Table:
        task, side, band, ids, n, part = (table.column(c).to_numpy() for c in ("task", "side", "band", "id", "n", "part"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
        likely = np.zeros(len(ids), dtype=bool)
        for rows in _task_rows(task):
            left, right = rows[side[rows] != 1], rows[side[rows] != 0]
            step = max(1, 40_000 // max(len(right), 1))
            for at in range(0, len(left), step):
                x, y = np.repeat(left[at : at + step], len(right)), np.tile(right, len(left[at : at + step]))
                low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                open_ = (part[x] != part[y]) & (100 * low >= percent * high)
                open_ &= (ids[x] < ids[y]) | (side[x] != -1)  # a block that meets itself needs each pair once
                x, y = x[open_], y[open_]
                near = estimated_above(percent / 100 - SLACK, register_counts(sketch[x], sketch[y]), n[x].astype(float), n[y].astype(float))
                x, y = x[near], y[near]
                first = (sketch[x] == sketch[y]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[x]
                likely[x[first]] = likely[y[first]] = True
        return table.select(["task", "side", "id", "n", "part"]).filter(pa.array(likely))

    return job


def _linked_members(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join, in each task, the members (task, side, id, n, part) that their full sets link."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = members.agg(F.sum("n")).first()[0] or 0
    box = F.pmod(F.xxhash64("task"), F.lit(-(-total // BOX_SHINGLES) or 1))
    return members.join(sieved(texts, "id", members, "id"), "id").groupBy(box.alias("box")).applyInArrow(_linked(k, percent), "a long, b long").distinct()


def _linked(k: int, percent: int):
    def job(table: pa.Table) -> pa.Table:
        task, side, ids, part = (table.column(c).to_numpy() for c in ("task", "side", "id", "part"))
        sets = [found for part_ in table.column("text").chunks for _, texts in chunks(part_, STEP_BYTES) for found in shingle_sets(texts, k)]
        size = np.array([len(x) for x in sets])
        found = [np.empty((2, 0), dtype=np.int64)]
        for rows in _task_rows(task):
            rows = rows[size[rows] > 0]
            left, right = np.flatnonzero(side[rows] != 1), np.flatnonzero(side[rows] != 0)
            if not len(left) or not len(right):
                continue
            words, number = np.unique(np.concatenate([sets[r] for r in rows[right]]), return_inverse=True)
            starts = np.cumsum(size[rows[right]]) - size[rows[right]]
            label = np.arange(len(rows))
            for i in left:
                own = sets[rows[i]]
                at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                mark = np.zeros(len(words), dtype=np.int32)
                mark[at[words[at] == own]] = 1
                shared = np.add.reduceat(mark[number], starts)
                near = 100 * shared >= percent * (len(own) + size[rows[right]] - shared)
                joined = np.unique(label[np.append(right[near & (part[rows[right]] != part[rows[i]])], i)])
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
            moved = np.flatnonzero(label != np.arange(len(rows)))
            found.append(np.stack((ids[rows[moved]], ids[rows[label[moved]]])))
        pairs = np.concatenate(found, axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return job


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = SIMILARITY) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps, with all their columns. Rows with a null id or
    without words stay; rows that repeat an id stay or go together; an empty table stays empty."""
    gone = near_duplicates(docs, id_col, text_col, shingle_words, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__tallyspark_dropped")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__tallyspark_dropped"), "left_anti")
