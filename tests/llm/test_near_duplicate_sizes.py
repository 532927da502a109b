"""What near-duplicate detection keeps in the shared folder, and the sieve before its joins."""

from pathlib import Path

from pyspark.sql import functions as F

from tallyspark.llm import common, setsketch


def test_no_full_sets_are_kept(spark, monkeypatch):
    sizes = []

    def measured(df, what):
        out = common.materialise(df, what)
        sizes.append(sum(p.stat().st_size for p in Path(out.stage_path.removeprefix("file://")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(setsketch, "materialise", measured)
    words = [f"w{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(i, " ".join(words[: 20_000 - i])) for i in range(3)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(docs.coalesce(1), shingle_words=2).collect()}
    assert got == {i: (19_999 - i, 0) for i in range(3)}
    assert max(sizes) < 100_000  # a full set takes 160,000 bytes


def test_sieve(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("id"), F.lit("x").alias("text"))
    wanted = spark.range(0, 100_000, 50).toDF("a").unionByName(spark.range(0, 500, 50).toDF("a"))
    found = common.sieved(rows, "id", wanted, "a")
    assert found.columns == rows.columns
    ids = [r.id for r in found.collect()]
    assert len(ids) == len(set(ids)) and set(range(0, 100_000, 50)) <= set(ids) and len(ids) < 20_000
    assert common.sieved(rows, "id", wanted.limit(0), "a").count() == 0
