"""Steps by keys in slices, and what writes leave on the executors' disks."""

import random
import time

import pytest

from tallyspark.operators import matching, run, splits
from tallyspark.operators.common import checkpointed

from .test_finance import ROW, row
from .test_whole_runs import MONEY_ROW, money_rows


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_shuffle_files_go_with_the_write(spark):
    before = shuffle_files(spark)
    df = spark.range(1_000).repartition(3, "id")
    out = checkpointed(df)
    for _ in range(50):
        if (left := shuffle_files(spark)) <= before:
            break
        time.sleep(0.1)
    assert left <= before and df is not None  # though `df` is still there
    assert out.count() == df.count() == 1_000


def sides(spark):
    out = []
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = [row(uid, rng.choice(["HOT", "A", "B", f"K{uid}", ""]), 1 + uid % 3, rng.choice(["1.00", "2.00", "9.00"])) for uid in rng.sample(range(200), 60)]
        out.append(spark.createDataFrame([(*r[:3], rng.choice(["7", "8", str(r[0]), ""]), *r[4:]) for r in rows], ROW))
    return out


def test_slices_give_the_rows_of_one(spark, monkeypatch):
    def shown():
        done = run.run(*sides(spark))
        rows = [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in (done.outcomes, done.splits, done.exceptions)]
        return rows, done.counters, done.totals

    one = shown()
    monkeypatch.setattr(matching, "SLICE", 50)
    several = shown()
    assert one == several and len(one[0][0]) > 20 and len(one[0][2]) > 10


@pytest.mark.parametrize("slice_, n", [(1 << 20, 1), (25, 5)])
def test_a_slice_holds_its_keys_alone(spark, monkeypatch, slice_, n):
    monkeypatch.setattr(matching, "SLICE", slice_)
    kept = [checkpointed(matching.dealt(side, "canonical_id")) for side in sides(spark)]
    parts = list(matching.slices(*kept))
    keys = [{r.canonical_id for side in part for r in side.where("canonical_id != ''").collect()} for part in parts]
    assert len(parts) == n and sum(side.count() for part in parts for side in part) == 120
    assert len(set().union(*keys)) == sum(map(len, keys))


def test_plans_of_splits_stay_small(spark):
    frames = [spark.createDataFrame(money_rows(s, 20, 0), MONEY_ROW) for s in (1, 2)]
    assert len(splits.split_candidates(*frames, 3, 5)._jdf.queryExecution().toString()) < 30_000
