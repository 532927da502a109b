"""What runs leave in the shared folder."""

from tallyspark import queries
from tallyspark.operators import matching
from tallyspark.operators.common import kept
from tallyspark.queries import T, sides
from tallyspark.run_queries import whole_run

SMALL = "/root/testdata/sf0.001"


def test_a_run_keeps_its_results_only(spark):
    before = kept(spark)
    done = whole_run(spark, SMALL)
    left = kept(spark) - before
    assert len(left) == 6  # four passes, splits, exceptions
    assert done.outcomes.count() and done.exceptions.count() == done.totals["exceptions"] and done.splits.count() == done.totals["splits"]
    assert all(f.split("/kept-")[1].split("/")[0] in {p.split("/kept-")[1] for p in left} for f in done.outcomes.inputFiles() + done.exceptions.inputFiles())


def test_passes_keep_their_results_only(spark):
    before = kept(spark)
    outcomes, found = matching.reconcile(*sides(spark, SMALL), T)
    assert len(kept(spark) - before) == 5
    assert outcomes.count() and found.count() >= 0


def test_working_capital_cleans_ids_only_and_pairs_once(spark):
    before = kept(spark)
    assert queries.QUERIES["d16_working_capital"](spark, SMALL).count() == 1
    columns = sorted(sorted(spark.read.parquet(p).columns) for p in kept(spark) - before)
    assert len(columns) == 3 and ["dt_a", "dt_b", "is_match", "uid_a"] in columns  # both sides, pairs
    assert not {"clean_ref", "entity"} & {c for table in columns for c in table}
