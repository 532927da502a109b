"""Exact top-k by inner product: histograms of all scores locate each query's k-th value.

Queries and candidates are cut into blocks, and each pair of blocks is a task that scores all of its
pairs; no block grows with the table. Every round, tasks count the scores of a query by bins of the
range in which its k-th value must lie, and the sums over all blocks narrow that range to one bin,
until it holds a single value. The last round keeps the scores above that value, and of those equal
to it the smallest ids. A block's histogram ends with its k best scores: lower bins can't hold the
k-th value of all, as the block alone has k scores above them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: Components of a block of candidates at about, and of a block of queries; rows that a block has at
#: least before there are more blocks than tasks, bins of a round, and scores that one numpy step holds.
BLOCK, QUERY_BLOCK, LEAST_BLOCK, BINS, STEP = 1 << 20, 1 << 18, 512, 4_096, 1 << 22
#: Scores beyond this, up or down, count as this.
LIMIT = (1 << 62) - (1 << 40)
#: Products stay exact in doubles up to here, beyond it in Python's integers.
EXACT = 1 << 53


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), dim)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as longs, within LIMIT."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q).dot(whole(c).T), -LIMIT, LIMIT).astype(np.int64)


def _pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]]:
    """(scores, own, candidate ids, query rows) of a task, some queries at a time; `own` marks pairs of
    a query with rows of its own id, which are no candidates."""
    dim = int(table.column("dim")[0].as_py()) if table.num_rows else 0
    is_query = table.column("is_query").to_numpy(zero_copy_only=False)
    queries, rows = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
    if not queries.num_rows or not rows.num_rows:
        return
    rows = rows.sort_by("vec_id")
    q, c = _matrix(queries.column("vector"), dim), _matrix(rows.column("vector"), dim)
    ids, about = rows.column("vec_id").to_numpy(), queries.select(["query", "vec_id", "low", "width", "need", "bins"]).to_pandas()
    step = max(1, STEP // len(c))
    for at in range(0, len(q), step):
        part = about.iloc[at : at + step]
        yield _scores(q[at : at + step], c), part["vec_id"].to_numpy()[:, None] == ids[None, :], ids, part


def _counted(table: pa.Table) -> pa.Table:
    """query, bin and n: the block's share of each query's histogram, down to its `need` best scores."""
    out = [pd.DataFrame({"query": [], "bin": [], "n": []}, dtype="int64")]
    for scores, own, _, about in _pairs(table):
        low, width, need, bins = (about[c].to_numpy()[:, None] for c in ("low", "width", "need", "bins"))
        bin_ = np.where(own | (scores < low), -1, (scores - np.minimum(low, scores)) // width)
        bin_[bin_ >= bins] = -1  # counted before
        k = min(int(need.max()), bin_.shape[1])
        best = -np.partition(-bin_, k - 1, axis=1)[:, :k]
        best = -np.sort(-best, axis=1)
        row, place = np.nonzero((best >= 0) & (np.arange(k)[None, :] < need))
        out.append(pd.DataFrame({"query": about["query"].to_numpy()[row], "bin": best[row, place]}).value_counts().rename("n").reset_index())
    return pa.Table.from_pandas(pd.concat(out), schema=pa.schema([("query", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())]), preserve_index=False)


def _kept(table: pa.Table) -> pa.Table:
    """query, query_id, vec_id and score of what is above the k-th value, and of the first `need` ids at it."""
    out = [pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")]
    for scores, own, ids, about in _pairs(table):
        low, need = about["low"].to_numpy()[:, None], about["need"].to_numpy()[:, None]
        level = ~own & (scores == low)
        take = ~own & (scores > low) | level & (np.cumsum(level, axis=1) <= need)  # candidates are sorted by id
        row, at = np.nonzero(take)
        out.append(pd.DataFrame({"query": about["query"].to_numpy()[row], "query_id": about["vec_id"].to_numpy()[row], "vec_id": ids[at], "score": scores[row, at]}))
    return pa.Table.from_pandas(pd.concat(out), schema=pa.schema([(c, pa.int64()) for c in ("query", "query_id", "vec_id", "score")]), preserve_index=False)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of every row whose id is divisible by
    `every`, by the integer inner product of floor(scale * x); ties go to the smaller vec_id.

    Rows without an id or a vector, or with a null or non-finite component, take no part. Only vectors
    of one length are compared. A query's own row is every row of its id; rows that repeat are
    candidates each, and queries that repeat are answered each. A query with fewer than k candidates
    gets all. Scores beyond LIMIT count as LIMIT. An empty table gives no rows, and other columns are
    ignored. Vectors of any length will do: longer ones come in smaller blocks."""
    spark = vectors.sparkSession
    x = F.col("_v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))))
    # Whole numbers as doubles; doubles from 2^52 on are whole.
    held = lambda y: F.greatest(F.least(y * scale, F.lit(1e300)), F.lit(-1e300))
    whole = F.transform(x, lambda y: F.when(F.abs(held(y)) < float(1 << 52), F.floor(held(y)).cast("double")).otherwise(held(y)))
    rows = rows.select("vec_id", F.size("_v").alias("dim"), whole.alias("vector"))
    rows = materialise(rows.withColumn("size", F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0))), "vectors")
    n, most, dim = rows.agg(F.count(F.lit(1)), F.max("size"), F.max("dim")).first()
    is_query = F.col("vec_id") % every == 0
    n_queries = rows.where(is_query).count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n * max(1, dim) // BLOCK), min(parallel, -(-n // LEAST_BLOCK)))
    query_blocks = -(-n_queries * max(1, dim) // QUERY_BLOCK)
    dealt = F.xxhash64("vec_id", F.monotonically_increasing_id())  # rows of one id may be many
    own = rows.withColumn("block", F.pmod(dealt, F.lit(blocks)).cast("int"))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = materialise(own.select("dim", "block", "vec_id", "vector"), "candidates")
    queries = rows.where(is_query).withColumns({"query": F.monotonically_increasing_id(), "query_block": F.pmod(dealt, F.lit(query_blocks)).cast("int")})
    queries = materialise(queries, "queries")

    # A score lies within the sum of a query's components times the largest component of any row.
    reach = F.least(F.aggregate("vector", F.lit(0.0), lambda a, y: a + F.abs(y)) * (1.001 * (most or 0)), F.lit(float(LIMIT))).cast("long") + 2
    state = queries.select("query", (-reach).alias("low"), (2 * reach).alias("span"), F.lit(k).cast("long").alias("need"))
    state = _fixed(state)

    def tasks(state: DataFrame) -> DataFrame:
        asked = queries.join(state, "query").select("dim", each(blocks).alias("block"), "query_block", "vec_id", "vector", F.lit(True).alias("is_query"), "query", "low", "width", "need", "bins")
        none = F.lit(0).cast("long")
        known = candidates.select("dim", "block", each(query_blocks).alias("query_block"), "vec_id", "vector", F.lit(False).alias("is_query"), *(none.alias(c) for c in ("query", "low", "width", "need", "bins")))
        return asked.unionByName(known).groupBy("dim", "block", "query_block")

    while state.where("span > 1").limit(1).count():
        counts = tasks(state).applyInArrow(_counted, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        # The k-th value's bin: the first from above at which `need` scores are reached. Beside it, a
        # query has fewer than `need` scores in all of its bins but the one that reaches it.
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        reached = counts.withColumn("above", F.sum("n").over(down) - F.col("n")).join(state, "query").where("above < need")
        found = reached.groupBy("query").agg(F.min("bin").alias("bin"), F.max("above").alias("above"), F.sum("n").alias("seen"))
        later = state.join(found, "query", "left")
        short = F.coalesce("seen", F.lit(0)) < F.col("need")  # fewer candidates than asked for: take all
        narrowed = later.select(
            "query", F.when(short, F.col("low")).otherwise(F.col("low") + F.col("bin") * F.col("width")).alias("low"),
            F.when(short, F.lit(1).cast("long")).otherwise(F.least("width", F.col("span") - F.col("bin") * F.col("width"))).alias("span"),
            F.when(short, F.col("need")).otherwise(F.col("need") - F.col("above")).alias("need"),
        )
        before, state = state, _fixed(narrowed)
        discard(before)

    kept = tasks(state).applyInArrow(_kept, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _fixed(state: DataFrame) -> DataFrame:
    """The queries' ranges as a stage table, with the width and number of the next bins."""
    width = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("span") / F.lit(BINS)).cast("long"))
    return materialise(state.withColumn("width", width).withColumn("bins", F.ceil(F.col("span") / F.col("width")).cast("long")), "ranges")
