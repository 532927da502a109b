"""The pipeline against its stages by brute force, and the queries against their SQL."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tallyspark.llm import queries
from tests.test_helpers import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_like_its_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def test_stages(spark):
    """Each stage keeps what it should of its own input; the last places every document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.columns == columns
        seen.append(out)
    toxic, exact, near, clean = (x.toPandas() for x in seen[1:])
    lower = toxic["text"].map(lambda t: t.encode().lower())
    assert set(exact["doc_id"]) == set(toxic.groupby(lower)["doc_id"].max())
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in exact.itertuples() for w in [r.text.encode().lower().split()]}
    top = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in links:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    assert set(near["doc_id"]) == set(top.values())
    assert set(clean["doc_id"]) == set(near["doc_id"]) and (clean["text"].str.len() == clean["n_chars"]).all()
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed["doc_id"]) == set(near["doc_id"]) and packed.groupby("sequence_id")["length"].sum().max() <= 2048




ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, rep long, sketch string, key string, id long"
EXTRA = (0.5, False, 3, "s", "k", 7)


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = [(0, None), (1, ""), (2, None), (3, " \n"), (4, "One two three four five six seven"), (5, "one TWO three four five six seven"), (6, long), (7, long + " end"), (None, "no id here at all today friend"), (8, "mail me at a.b@c.example.com now")]
    texts += [(8, "mail me at a.b@c.example.com now"), (9, "unlike any other text of this table")]
    return [(i, t, None if i == 4 else "en", None, None if t is None else len(t), *EXTRA) for i, t in texts]


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and clashing names, by hand."""
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    toxic, exact, near, personal, packing = (stage for _, stage in corpus_pipeline.STAGES)
    ids = lambda df: sorted((str(r.doc_id) for r in df.collect()))
    assert ids(toxic(spark, docs, SF)) == ids(docs)
    once = exact(spark, docs, SF)
    assert ids(once) == sorted(["2", "3", "5", "6", "7", "8", "8", "9", "None"])  # 0, 1 and 2 are empty, 4 is like 5
    left = near(spark, once, SF)
    assert ids(left) == sorted(["2", "3", "5", "6", "8", "8", "9", "None"])  # 7 is near 6
    clean = personal(spark, left, SF)
    texts = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert texts[8] == ("mail me at [EMAIL] now", 22) and texts[2] == (None, None) and ids(clean) == ids(left)
    for out in (once, left, clean):
        assert out.columns == docs.columns and {(r.score, r.kept, r.rep, r.sketch, r.key, r.id) for r in out.collect()} == {EXTRA}
    packed = packing(spark, clean, SF).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048 and set(map(str, packed["doc_id"].astype("Int64"))) == {"2", "3", "5", "6", "8", "9", "<NA>"}
    assert personal(spark, left.drop("n_chars"), SF).columns == [c for c in docs.columns if c != "n_chars"]


def test_stages_of_an_empty_table(spark):
    none = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
