"""Prefix sums over a table in a total order, in two levels: inside range partitions, then between them.

Rows are dealt to ranges of the order, so that a key with very many rows spreads over tasks. Every
task sums its own range batch by batch; what the ranges hand on to the next ones is one row a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _within(key: str | None, sums: dict[str, str], xors: dict[str, str]):
    """Running values of a range: `_part` is the range, `_at` the row's place in it."""

    def job(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, last = TaskContext.get().partitionId(), 0, None
        have = {c: np.int64(0) for c in (*sums, *xors)}
        for pdf in parts:
            n = len(pdf)
            if not n:
                continue
            keys = pdf[key].to_numpy() if key else np.zeros(n, dtype=np.int64)
            new = np.empty(n, dtype=bool)
            new[0], new[1:] = last is None or keys[0] != last, keys[1:] != keys[:-1]
            starts, group = np.flatnonzero(new), np.cumsum(new)
            out = {"_part": np.full(n, part), "_at": np.arange(at, at + n)}
            for name, column in sums.items():
                values = pdf[column].to_numpy(dtype=np.int64)
                total = np.cumsum(values)
                out[name] = total - np.concatenate(([-have[name]], total[starts] - values[starts]))[group]
            for name, column in xors.items():
                values = pdf[column].to_numpy(dtype=np.int64)
                total = np.bitwise_xor.accumulate(values)
                out[name] = total ^ np.concatenate(([have[name]], total[starts] ^ values[starts]))[group]
            have, last, at = {c: out[c][-1] for c in have}, keys[-1], at + n
            yield pdf.assign(**out)

    return job


def running(rows: DataFrame, key: str | None, order: list[str], sums: dict[str, str], xors: dict[str, str] | None = None, drop: tuple[str, ...] = (), what: str = "scan") -> DataFrame:
    """`rows` with inclusive running sums {new column: column} in `order` (nulls first), and running
    exclusive-ors alike. With a `key` (long, not null), which must come first in `order`, each key has
    its own. The columns in `drop` serve the order only. The result reads a stage table."""
    spark, xors = rows.sparkSession, xors or {}
    dealt = rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order)).drop(*drop)
    new = {**sums, **xors}
    kinds = [f"`{c}` {kind}" for c, kind in dealt.dtypes] + [f"`{c}` long" for c in ("_part", "_at", *new)]
    stage = materialise(dealt.mapInPandas(_within(key, sums, xors), ", ".join(kinds)), what)

    own = F.col(key) if key else F.lit(0).cast("long")
    ends = stage.groupBy("_part").agg(F.min_by(own, "_at").alias("first"), F.max_by(F.struct(own.alias("key"), *new), "_at").alias("last")).orderBy("_part").collect()  # one row a range
    carry: list[tuple] = [(-1, 0, *[0] * len(new))]  # no range; so that there always is a row
    open_key, have = None, [0] * len(new)
    for end in ends:
        mine = [end["last"][c] for c in new]
        if end["first"] == open_key:
            carry.append((end["_part"], open_key, *have))
            if end["last"]["key"] == open_key:
                mine = [a + b if c in sums else a ^ b for c, a, b in zip(new, mine, have, strict=True)]
        open_key, have = end["last"]["key"], mine
    names = [f"_before_{c}" for c in new]
    before = spark.createDataFrame(carry, ", ".join(f"`{c}` long" for c in ("_range", "_key", *names)))
    joined = stage.join(F.broadcast(before), (F.col("_part") == F.col("_range")) & (own == F.col("_key")), "left")
    values = {c: F.col(c) + F.coalesce(f"_before_{c}", F.lit(0)) for c in sums} | {c: F.col(c).bitwiseXOR(F.coalesce(f"_before_{c}", F.lit(0).cast("long"))) for c in xors}
    return joined.withColumns(values).drop("_part", "_at", "_range", "_key", *names)
