"""The stored index, kept pages, fingerprints and workbooks."""

from __future__ import annotations

import random
import re
import uuid
import zipfile
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import index
from tallyspark.operators.index import PagedOrder, SearchIndex, bucket_of
from tallyspark.sources import files, workbooks


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def files_read(df):
    """Files that a plain scan has read."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_search_like_a_loop_and_by_its_buckets(spark, root):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gamma", "delta42", "the"]) for _ in range(rng.randrange(6))) for _ in range(200)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "source x") for i, t in enumerate(texts)], "id long, text string, extra string")
    index = SearchIndex(spark, root, 16).build(docs, "id", ["text", "extra"])
    status, rows = index.search("beta BETA gamma, nothing", limit=300, id_kind="long")
    own = [set(re.findall("[a-z0-9]+", f"{t or ''} source x".lower())) for t in texts]
    df = Counter(t for s in own for t in s)
    idf = {t: log((len(texts) + 1) / (df[t] + 1)) + 1 for t in df}
    want = sorted((-(2 * idf["beta"] * ("beta" in s) + idf["gamma"] * ("gamma" in s)), -(2 * ("beta" in s) + ("gamma" in s)), i) for i, s in enumerate(own) if s & {"beta", "gamma"})
    assert status == "OK" and [(r.id, r.n_terms) for r in rows.collect()] == [(i, -n) for _, n, i in want]
    assert rows.first().matched == ["beta", "gamma"] and rows.first().score == round(-want[0][0], 4)
    every = len([f for f in spark.read.parquet(f"{root}/postings").inputFiles()])
    assert files_read(index.postings(["beta"], "long")) == len([f for f in spark.read.parquet(f"{root}/postings").inputFiles() if f"bucket={bucket_of('beta', 16)}/" in f]) < every


def test_search_says_why_it_finds_nothing(spark, root):
    docs = spark.createDataFrame([(1, "alpha")], "id long, text string")
    index = SearchIndex(spark, f"{root}/a").build(docs, "id", ["text"])
    empty = SearchIndex(spark, f"{root}/b").build(docs.limit(0), "id", ["text"])
    assert [index.search(q, id_kind="long")[0] for q in (None, " ", "!?", "beta", "Alpha")] == ["NO_QUERY", "NO_QUERY", "NO_QUERY", "NO_MATCH", "OK"]
    assert [empty.search(q, id_kind="long")[0] for q in (" ", "alpha")] == ["NO_QUERY", "NO_DATA"] and index.search("beta", id_kind="long")[1].count() == 0


def test_deep_pages_read_one_range(spark, root):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, *range(300)])) for i in range(5_000)]
    paged = PagedOrder(spark, root).build(spark.createDataFrame(rows, "id long, worth long").repartition(5), [("worth", True), ("id", False)], per_range=250)
    want = [i for i, w in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert paged.total == 5_000 and len(paged.sizes) > 8
    for offset in (0, 17, 2_499, 4_960, 4_990, 6_000):
        assert [r.id for r in paged.page(offset, 40).orderBy(F.desc_nulls_last("worth"), "id").collect()] == want[offset : offset + 40]
    assert len(paged.ranges(3_000, 10)[0]) <= 2
    last = paged.page(99, 1).first()
    assert [r.id for r in paged.after({"worth": last.worth, "id": last.id}, 30).orderBy(F.desc_nulls_last("worth"), "id").collect()] == want[100:130]


def test_ranges_share_tasks_and_files(spark, root):
    rows = spark.range(5_000).select(F.col("id"), F.pmod("id", F.lit(7)).alias("worth")).repartition(5)
    paged = PagedOrder(spark, root).build(rows, [("worth", True), ("id", False)], per_range=250)
    assert [n for _, n in paged.sizes] == [250] * 20 and len(paged._kept().inputFiles()) == 1
    names, _ = paged.ranges(3_010, 10)
    part = paged.within(names)
    assert part.count() == 250 and len(names) == 1
    part.collect()
    scan = part._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() <= 500  # the range's pages of the file


def test_many_files_and_equal_rows_are_kept_in_order(spark, root, monkeypatch):
    monkeypatch.setattr(index, "RANGES_OF_FILE", 3)
    rng = random.Random(3)
    values = [rng.choice([None, 1, 1, 1, *range(40)]) for _ in range(2_000)]
    paged = PagedOrder(spark, root).build(spark.createDataFrame([(v,) for v in values], "worth long").repartition(6), [("worth", False)], per_range=50)
    want = sorted(values, key=lambda v: (v is None, v or 0))
    assert len(paged._kept().inputFiles()) > 5 and paged.total == 2_000
    for offset in (0, 49, 50, 140, 777, 1_990, 2_000):
        assert [r.worth for r in paged.page(offset, 120).collect()] == want[offset : offset + 120]


def test_equal_multisets_have_equal_prints(spark):
    rows = [("a", "x"), ("a", "y"), ("a", "x"), ("b", "y"), ("b", "x"), ("b", "x"), ("c", "x"), ("c", "y"), ("d", None)]
    df = spark.createDataFrame(rows, "doc string, item string").repartition(4)
    got = {r.doc: r.h for r in df.groupBy("doc").agg(files.multiset_hash(F.col("item")).alias("h")).collect()}
    assert got["a"] == got["b"] != got["c"] and len(set(got.values())) == 3
    records = files.normal_records(spark.createDataFrame([("T1", "5", "2026-08-01"), ("T2", "6", "2026-08-02")], "txn_id string, amount string, date string"), "s")
    prints = [r.fingerprint for r in files.fingerprint(records.unionByName(records.withColumn("source", F.lit("t")).orderBy(F.desc("record_id"))), "source").collect()]
    assert len(prints) == 2 and prints[0] == prints[1]


def workbook(path, rows, shared=("name", "worth", "when", "Rich text")):
    """A workbook by hand: texts that cells share, inline ones, numbers, dates, gaps and errors."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{t[:2]}</t></r><r><t>{t[2:]}</t></r></si>" for t in shared) + "</sst>")
        out.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="2"/></cellXfs></styleSheet>')
        out.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        out.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")


HEAD = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'


def test_workbooks(spark, tmp_path):
    rows = HEAD + '<row r="2"><c r="A2" t="s"><v>3</v></c><c r="B2" s="3"><v>1050.25</v></c><c r="C2" s="1"><v>46235</v></c></row>'
    rows += '<row r="4"><c r="A4" t="inlineStr"><is><t>inline</t></is></c><c r="C4" s="2"><v>46235.5</v></c></row><row r="5"><c r="B5" t="e"><v>#DIV/0!</v></c><c r="C5" t="b"><v>1</v></c></row>'
    workbook(tmp_path / "a.xlsx", rows)
    got = files.read_any(spark, f"file://{tmp_path}/a.xlsx")
    assert got.columns == ["name", "worth", "when"]
    assert sorted(tuple(r) for r in got.fillna("-").collect()) == [("-", "-", "TRUE"), ("Rich text", "1050.25", "2026-08-01"), ("inline", "-", "2026-08-01 12:00:00")]
    assert list(workbooks.cells(b"no workbook")) == [] and workbooks._column("AA10") == 26
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    workbook(tmp_path / "c.xlsx", HEAD + '<row><c><v>7</v></c></row>')
    both = files.read_xlsx(spark, f"file://{tmp_path}")
    assert sorted(r.name for r in both.fillna("-").collect()) == ["-", "7", "Rich text", "inline"]


def test_large_workbooks_are_left_out(spark, tmp_path, monkeypatch):
    workbook(tmp_path / "a.xlsx", HEAD + '<row r="2"><c r="A2"><v>1</v></c></row>')
    monkeypatch.setattr(files, "MAX_BYTES", 10)
    with pytest.raises(Exception):  # nothing is read, so there are no columns
        files.read_xlsx(spark, f"file://{tmp_path}/a.xlsx").first().name
