"""Greedy choice, splits, ranks and whole runs against plain loops."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import matching, run, settle, splits

from .test_finance import ROW, row

DAY = datetime.date(2026, 8, 1)


def sequential(edges, order):
    taken, out = set(), []
    for e in sorted(edges, key=order):
        if taken.isdisjoint(e[1]):
            taken.update(e[1])
            out.append(e[0])
    return sorted(out)


def settled_ids(spark, edges):
    """edges: (id, (points), weight), visited by weight, then id."""
    n = len(edges[0][1])
    ends = [f"p{i}" for i in range(n)]
    df = spark.createDataFrame([(e[0], e[2], *e[1]) for e in edges], "id long, w long, " + ", ".join(f"{c} long" for c in ends)).repartition(5)
    return sorted(r.id for r in settle.settled(df, ends, ["w", "id"]).collect())


def graphs():
    rng = random.Random(1)
    chain = [(i, (i, i + 1), (i * 7919) % 10_007) for i in range(10_000)]
    sorted_chain = [(i, (i, i + 1), i) for i in range(3_000)]  # the worst case for rounds
    star = [(i, (0, i + 1), rng.randrange(100)) for i in range(2_000)]
    triples = [(i, tuple(rng.sample(range(300), 3)), rng.randrange(20)) for i in range(1_500)]
    return {"chain": chain, "sorted chain": sorted_chain, "star": star, "triples": triples}


@pytest.mark.parametrize("name", ["chain", "sorted chain", "star", "triples"])
def test_settled_like_a_sequential_loop(spark, name):
    edges = graphs()[name]
    assert settled_ids(spark, edges) == sequential(edges, lambda e: (e[2], e[0]))


@pytest.mark.parametrize("name", ["chain", "triples"])
def test_settled_in_rounds_of_tasks_and_giants(spark, monkeypatch, name):
    for what, value in (("ONE_TASK", 400), ("GIANT", 300), ("ROUNDS", 1)):
        monkeypatch.setattr(settle, what, value)
    edges = graphs()[name][:1_200]
    assert settled_ids(spark, edges) == sequential(edges, lambda e: (e[2], e[0]))


def test_a_long_chain_takes_as_many_jobs_as_a_short_one(spark):
    def jobs(edges):
        before = {j for g in [None] for j in spark.sparkContext.statusTracker().getJobIdsForGroup(g)}
        settled_ids(spark, edges)
        return len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before)

    assert jobs(graphs()["sorted chain"]) <= jobs(graphs()["sorted chain"][:3]) + 2


def test_nothing_to_settle(spark):
    none = spark.createDataFrame([], "id long, p0 long, p1 long")
    assert settle.settled(none, ["p0", "p1"], ["id"]).count() == 0


def money_rows(seed, n, first):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        day = None if rng.random() < 0.1 else DAY + datetime.timedelta(days=rng.randrange(12))
        cents = None if rng.random() < 0.05 else rng.choice([rng.randrange(-300, 900), rng.randrange(20) * 25])
        out.append((first + i, f"R{rng.randrange(10**6)}", day, None if cents is None else Decimal(cents) / 100))
    return out


def brute(one, two, days, tolerance):
    near = lambda x, y: x is None or y is None or abs((x - y).days) <= days
    out = set()
    for s in one:
        for i, g in enumerate(two):
            for h in two[i + 1 :]:
                if None not in (s[3], g[3], h[3]) and near(s[2], g[2]) and near(s[2], h[2]) and abs(g[3] + h[3] - s[3]) <= tolerance:
                    out.add((s[0], min(g[0], h[0]), max(g[0], h[0]), int(abs(g[3] + h[3] - s[3]) * 100)))
    return out


@pytest.mark.parametrize("cut", [4096, 5])
def test_split_candidates_like_brute_force(spark, monkeypatch, cut):
    monkeypatch.setattr(splits, "CUT", cut)
    monkeypatch.setattr(splits, "STEP", 64)
    one, two = money_rows(1, 60, 0), money_rows(2, 70, 500)
    kind = "uid long, record_id string, dt date, amount decimal(18,2)"
    found = splits.split_candidates(spark.createDataFrame(one, kind), spark.createDataFrame(two, kind), 3, 5).collect()
    assert len(found) == len({tuple(r) for r in found})
    want = brute(one, two, 3, Decimal("0.05"))
    assert {tuple(r) for r in found} == want and len(want) > 100


def test_splits_make_no_cross_join(spark):
    kind = "uid long, record_id string, dt date, amount decimal(18,2)"
    frames = [spark.createDataFrame(money_rows(s, 20, 0), kind) for s in (1, 2)]
    plan = splits.split_candidates(*frames, 3, 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("block", [1 << 20, 4])
def test_rank_zip_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "RANK_BLOCK", block)
    rng = random.Random(4)
    sides = []
    for seed in (1, 2):
        rng.seed(seed)
        sides.append([row(uid, rng.choice(["HOT", "HOT", "A", "B", f"K{uid}", ""]), 1, "1.00") for uid in rng.sample(range(400), 90)])
    got = {(r.uid_a, r.uid_b) for r in matching.rank_zip(*(spark.createDataFrame(s, ROW) for s in sides), "canonical_id").collect()}
    want = set()
    for key in {r[2] for r in sides[0]} - {""}:
        a, b = (sorted(r[0] for r in s if r[2] == key) for s in sides)
        want |= set(zip(a, b, strict=False))
    assert got == want


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_a_run_reports_each_row_once(spark):
    a = [row(0, "TXN_002", 2, "2450.00"), row(2, "FX-200", 3, "100.00"), row(4, "ORD_A", 10, "150.00"), row(6, "REC-1", 1, "3200.00"), row(8, "TXN_C", 20, "77.00"), row(10, "LONE", 25, "1.00")]
    b = [row(0, "TXN_002", 2, "2000.00"), row(2, "TXN_OTHER_999", 2, "2450.00"), row(4, "FX-200", 3, "85.00", "EUR"), row(6, "LINE_X", 10, "150.00"), row(8, "LINE_Y", 10, "150.00")]
    b += [row(10, "BNK-2", 1, "2600.00"), row(12, "BNK-3", 2, "600.00"), row(14, "TXN_C", 20, "77.00")]
    done = run.run(frame(spark, a), frame(spark, b))
    exceptions = [(r.origin, r.uid, r.reason, r.discrepancy, r.counterpart_id) for r in done.exceptions.collect()]
    assert sorted(exceptions) == [
        ("counterpart", 2, "UNRECORDED_TRANSACTION", Decimal("2450.00"), None), ("counterpart", 8, "UNRECORDED_TRANSACTION", Decimal("150.00"), None),
        ("pass", 0, "AMOUNT_MISMATCH", Decimal("450.00"), "TXN_002"), ("pass", 2, "CURRENCY_MISMATCH", Decimal("0.00"), "FX-200"), ("pass", 4, "AMBIGUOUS_CANDIDATE_CONFLICT", Decimal("150.00"), "LINE_X"),
        ("source", 10, "MISSING_COUNTERPART", Decimal("1.00"), None),
    ]
    assert done.counters == {"amount_mismatch": 1, "date_mismatch": 0, "currency_mismatch": 1, "missing_counterpart": 6, "ambiguous_candidate_conflict": 1, "missing_amount": 0, "invalid_record": 0}
    assert done.totals["matched_records"] == 1 and done.totals["splits"] == 1 and done.totals["match_rate"] == 16.7 and done.diagnosis is None
    assert {r.name: r.value for r in run.summary(spark, done).collect()}["matched_volume"] == "77.00"


def test_a_duplicate_or_missing_amount_stays_open(spark):
    a = [row(0, "A1", 1, "5.00"), (*row(2, "A2", 1, "1.00")[:5], None, None, *row(0, "", 1, "1")[7:])]
    b = [row(0, "B1", 20, "9.00"), row(2, "B1", 20, "9.50")]
    b[0], b[1] = (*b[0][:3], "77", *b[0][4:]), (*b[1][:3], "77", *b[1][4:])
    got = {(r.origin, r.uid, r.reason, r.discrepancy) for r in run.run(frame(spark, a), frame(spark, b)).exceptions.collect()}
    assert got == {("source", 0, "MISSING_COUNTERPART", Decimal("5.00")), ("source", 2, "MISSING_AMOUNT", Decimal("0.00")), ("counterpart", 0, "DUPLICATE_TRANSACTION", Decimal("9.00")), ("counterpart", 2, "DUPLICATE_TRANSACTION", Decimal("9.50"))}


@pytest.mark.parametrize(
    "b, starts",
    [
        ([], "0% Match: Zero candidate pairs"), ([row(0, "A", 1, "900.00"), row(2, "B", 1, "800.00")], "0% Match: Candidate transaction IDs"),
        ([row(0, "X", 20, "1.00", entity="e"), row(2, "Y", 20, "2.00", entity="f")], "0% Match: 4 candidate pairs"), ([row(0, "X", 20, "1.00", entity="q")], "0% Match: Identical amounts"),
    ],
)
def test_why_nothing_matches(spark, b, starts):
    a = [row(0, "A", 1, "1.00", entity="e"), row(2, "B", 1, "2.00", entity="f")]
    done = run.run(frame(spark, a), frame(spark, b))
    assert done.totals["match_rate"] == 0.0 and done.diagnosis.startswith(starts)
    assert done.exceptions.where("origin != 'counterpart'").count() == 2


def test_dates_alone_keep_rows_apart(spark):
    done = run.run(frame(spark, [row(0, "A", 1, "1.00", entity="e")]), frame(spark, [row(0, "X", 20, "1.00", entity="q")]))
    assert done.diagnosis is not None and done.counters["date_mismatch"] == 1  # its net amount adds no pair of its own
    empty = run.run(frame(spark, []), frame(spark, []))
    assert empty.diagnosis is None and empty.exceptions.count() == 0 and empty.totals["match_rate"] == 0.0


def test_open_rows_of_an_empty_other_side(spark):
    done = run.run(frame(spark, [row(0, "A", 1, "1.00")]), frame(spark, []))
    assert [(r.reason, r.level) for r in done.exceptions.collect()] == [("MISSING_COUNTERPART", "MATERIAL")]
    assert done.totals["material_discrepancies"] == 1


MONEY_ROW = "uid long, record_id string, dt date, amount decimal(18,2)"


@pytest.mark.parametrize("ids", ["plain", "joined"])
def test_splits_like_a_sequential_loop(spark, ids):
    rng = random.Random(9)
    texts = ["B-1", "B-10", "B-1-D", "B-100", "T-1", "T-10"] + [f"R{i}" for i in range(30)] + ["R~1"] * (ids == "joined")
    sides = [[(2 * i, rng.choice(texts), None if rng.random() < 0.1 else DAY + datetime.timedelta(days=rng.randrange(5)), Decimal(rng.choice(cents))) for i in range(n)] for n, cents in ((35, (150, 200, 300)), (45, (100, 200)))]
    if ids == "joined":
        sides[0][0] = (0, "R~1", DAY, Decimal(200))
    edges = []
    for kind, tag in zip(splits.KINDS, (0, 1), strict=True):
        one, two = sides[tag], sides[1 - tag]
        names = [{r[0]: r[1] for r in rows} for rows in (one, two)]
        for s, g, h, off in brute(one, two, 3, Decimal("0.05")):
            text = "~".join(sorted((names[0][s], names[1][g], names[1][h])))
            edges.append(((kind, s, g, h), ((tag, s), (1 - tag, g), (1 - tag, h)), (off, text, kind, s, g, h)))
    want = sequential(edges, lambda e: e[2])
    got = splits.splits(*(spark.createDataFrame(rows, MONEY_ROW) for rows in sides), 3, "0.05")
    assert sorted((r.kind, r.single, r.one, r.two) for r in got.collect()) == want and len(want) > 10


def test_equal_rows_are_not_multiplied_out(spark):
    """2,000 rows that any two of 4,000 add up to: 16,000 million splits, of which 2,000 are taken."""
    rows = lambda n, amount: spark.range(n).selectExpr("id * 2 AS uid", "concat('R', id) AS record_id", "DATE'2026-08-01' AS dt", f"CAST({amount} AS DECIMAL(18,2)) AS amount")
    got = splits.splits(rows(2_000, 200), rows(4_000, 100), 3, "0.05").collect()
    assert len(got) == 2_000 and len({u for r in got for u in (r.one, r.two)}) == 4_000
