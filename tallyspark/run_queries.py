"""Queries of whole reconciliation runs: all passes, splits, exceptions and counters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import matching, run, search, splits
from .queries import _LEFT2, T, kept_sides, second_pass, sides
from .registry import query

# The passes by amount and entity and the splits in SQL. A greedy choice visits its ordered edges one by
# one, with the list of all ends that are taken.


def _greedy(name: str, edges: str, points: str, order: str) -> str:
    return f"""{name}_o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, {points} AS pts FROM {edges}),
 {name}_g(i, used, took) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false UNION ALL
   SELECT g.i + 1, CASE WHEN list_has_any(g.used, o.pts) THEN g.used ELSE list_concat(g.used, o.pts) END, NOT list_has_any(g.used, o.pts) FROM {name}_g g JOIN {name}_o o ON o.rn = g.i + 1),
 {name} AS (SELECT o.* FROM {name}_o o JOIN {name}_g g ON g.i = o.rn WHERE g.took)"""


def _split(kind: str, one: str, two: str, x: str, y: str) -> str:
    near = lambda p, q: f"coalesce(abs({p}.dt - {q}.dt) <= 3, true)"
    return f"""SELECT '{kind}' AS kind, s.uid AS single, g.uid AS one, h.uid AS two, abs(g.amount + h.amount - s.amount) AS off,
   array_to_string(list_sort([s.record_id, g.record_id, h.record_id]), '~') AS ids, ['{x}' || s.uid, '{y}' || g.uid, '{y}' || h.uid] AS ends
   FROM {one} s JOIN {two} g ON {near('s', 'g')} JOIN {two} h ON h.uid > g.uid AND {near('s', 'h')} AND abs(g.amount + h.amount - s.amount) <= 0.05"""


_NET = "least(abs(x.net_amount - y.amount), abs(x.amount - y.net_amount), abs(x.net_amount - y.net_amount))"
_BAND = f"least(abs(x.amount - y.amount), {_NET})"
_PAIR = "x.uid AS uid_a, y.uid AS uid_b, x.amount AS amount_a, x.currency AS cx, y.currency AS cy, abs(x.dt - y.dt) AS days, abs(x.amount - y.amount) AS gross"
_DEGREES = "count(*) OVER (PARTITION BY uid_a) AS da, count(*) OVER (PARTITION BY uid_b) AS db"
_PASS3 = f"""{_LEFT2},
 c3 AS (SELECT *, {_DEGREES} FROM (SELECT {_PAIR}, CASE WHEN x.amount = y.amount THEN 0 ELSE 1 END AS phase, x.entity AS ex, y.entity AS ey FROM a2 x JOIN b2 y ON abs(x.dt - y.dt) <= 3 AND (x.amount = y.amount OR x.net_amount = y.net_amount))),
 {_greedy("g3", "c3", "['a' || uid_a, 'b' || uid_b]", "phase, uid_a, uid_b")},
 p3 AS (SELECT *, CASE WHEN cx <> cy THEN 'CURRENCY_MISMATCH' WHEN da > 1 OR db > 1 THEN 'AMBIGUOUS_CANDIDATE_CONFLICT' ELSE 'FUZZY_MATCH' END AS outcome,
   CASE WHEN ex = ey OR list_has_any(string_split(ex, ' '), string_split(ey, ' ')) THEN 85 ELSE 76 END AS score FROM g3)"""
_PASS4 = f"""{_PASS3},
 a3 AS (SELECT * FROM a2 WHERE uid NOT IN (SELECT uid_a FROM p3)), b3 AS (SELECT * FROM b2 WHERE uid NOT IN (SELECT uid_b FROM p3)),
 c4 AS (SELECT {_PAIR}, {_BAND} AS best FROM a3 x JOIN b3 y ON x.entity = y.entity AND abs(x.dt - y.dt) <= 3 WHERE {_BAND} <= 2.50), c4x AS (SELECT * FROM c4 WHERE cx <> cy),
 {_greedy("g4", "c4x", "['a' || uid_a, 'b' || uid_b]", "uid_a, uid_b")},
 s4 AS (SELECT * FROM (SELECT *, {_DEGREES} FROM c4 WHERE cx = cy) WHERE uid_a NOT IN (SELECT uid_a FROM g4) AND uid_b NOT IN (SELECT uid_b FROM g4)),
 p4 AS (SELECT uid_a, uid_b, amount_a, gross, best, 'CURRENCY_MISMATCH' AS outcome FROM g4 UNION ALL SELECT uid_a, uid_b, amount_a, gross, best, 'FUZZY_MATCH' FROM s4 WHERE da = 1 AND db = 1)"""


def _splits_of(left: str, one: str, two: str) -> str:
    return f"""{left}, cs AS ({_split(splits.KINDS[0], one, two, 'a', 'b')} UNION ALL {_split(splits.KINDS[1], two, one, 'b', 'a')}),
 {_greedy("sp", "cs", "ends", "off, ids, kind, single, one, two")}"""


_SPLIT = _splits_of(f"{_PASS4}, a4 AS (SELECT * FROM a3 WHERE uid NOT IN (SELECT uid_a FROM p4)), b4 AS (SELECT * FROM b3 WHERE uid NOT IN (SELECT uid_b FROM p4))", "a4", "b4")
_MATCH = "('EXACT_MATCH', 'TOLERANCE_MATCH', 'FUZZY_MATCH')"
_STRATEGY = lambda p, names: f"CASE WHEN outcome = 'TOLERANCE_MATCH' AND {p}.best > 0.05 THEN '{names[1]}' ELSE '{names[0]}' END"
_OUTCOMES = f"""{_SPLIT},
 oc AS (SELECT uid_a, uid_b, amount_a, gross, best, outcome, {_STRATEGY('p1', matching.ID_STRATEGIES)} AS strategy FROM p1 UNION ALL SELECT uid_a, uid_b, amount_a, gross, best, outcome, {_STRATEGY('p2', matching.REFERENCE_STRATEGIES)} FROM p2
  UNION ALL SELECT uid_a, uid_b, amount_a, gross, 0, outcome, 'FALLBACK_AMOUNT_DATE' FROM p3 UNION ALL SELECT uid_a, uid_b, amount_a, gross, best, outcome, 'FALLBACK_ENTITY_AMOUNT_DATE' FROM p4),
 ga AS (SELECT uid_a AS uid FROM oc UNION SELECT single FROM sp WHERE kind = '{splits.KINDS[0]}' UNION SELECT unnest([one, two]) FROM sp WHERE kind = '{splits.KINDS[1]}'),
 gb AS (SELECT uid_b AS uid FROM oc UNION SELECT single FROM sp WHERE kind = '{splits.KINDS[1]}' UNION SELECT unnest([one, two]) FROM sp WHERE kind = '{splits.KINDS[0]}')"""


def _open(side: str, other: str, origin: str, last: str) -> str:
    return f"""SELECT '{origin}' AS origin, r.uid, r.record_id, r.amount, CASE WHEN r.amount IS NULL THEN 'MISSING_AMOUNT' WHEN r.record_id IN (SELECT record_id FROM twice) THEN 'DUPLICATE_TRANSACTION'
   WHEN o.n > 1 THEN 'AMBIGUOUS_CANDIDATE_CONFLICT' WHEN o.n = 1 THEN 'AMOUNT_MISMATCH' ELSE '{last}' END AS reason, abs(r.amount - o.other) AS delta
   FROM {side} r LEFT JOIN (SELECT clean_ref, count(*) AS n, min(amount) AS other FROM {other} WHERE clean_ref <> '' GROUP BY 1) o ON o.clean_ref = r.clean_ref WHERE r.uid NOT IN (SELECT uid FROM g{side})"""


_TWICE = " UNION ALL ".join(f"SELECT record_id FROM {s} WHERE canonical_id IN (SELECT canonical_id FROM {s} GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT record_id FROM {s} SEMI JOIN (SELECT clean_ref, amount FROM {s} WHERE clean_ref <> '' GROUP BY ALL HAVING count(*) > 1) USING (clean_ref, amount)" for s in "ab")
_ALL = f"""{_OUTCOMES}, twice AS ({_TWICE}),
 opn AS ({_open('a', 'b', 'source', 'MISSING_COUNTERPART')} UNION ALL {_open('b', 'a', 'counterpart', 'UNRECORDED_TRANSACTION')}),
 every AS (SELECT 'pass' AS origin, uid_a AS uid, a.record_id, outcome AS reason, CASE WHEN outcome IN ('DUPLICATE_TRANSACTION', 'AMBIGUOUS_CANDIDATE_CONFLICT') THEN coalesce(amount_a, 0) WHEN outcome = 'AMOUNT_MISMATCH' THEN gross ELSE 0 END AS discrepancy
   FROM oc JOIN a ON a.uid = uid_a WHERE outcome NOT IN {_MATCH}
  UNION ALL SELECT origin, uid, record_id, reason, CASE reason WHEN 'MISSING_AMOUNT' THEN 0 WHEN 'AMOUNT_MISMATCH' THEN delta ELSE amount END FROM opn)"""


def whole_run(spark: SparkSession, sf_dir: str) -> run.Run:
    return run.run(*sides(spark, sf_dir), T)


@query(f"WITH RECURSIVE {_PASS3} SELECT uid_a, uid_b, outcome, days AS days_diff, CASE WHEN outcome = 'FUZZY_MATCH' THEN score END AS confidence FROM p3")
def j5_amount_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = second_pass(*kept_sides(spark, sf_dir))
    return matching.amount_pass(a, b, T).select("uid_a", "uid_b", "outcome", "days_diff", "confidence")


@query(f"WITH RECURSIVE {_PASS4} SELECT uid_a, uid_b, outcome FROM p4")
def j6_entity_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = second_pass(*kept_sides(spark, sf_dir))
    third = matching.checkpointed(matching.amount_pass(a, b, T))
    return matching.entity_pass(matching.residual(a, third, "a"), matching.residual(b, third, "b"), T).select("uid_a", "uid_b", "outcome")


@query(f"WITH RECURSIVE {_splits_of(_LEFT2, 'a2', 'b2')} SELECT kind, single, one, two, off AS diff, 80 AS confidence FROM sp", columns="diff")
def j7_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = second_pass(*kept_sides(spark, sf_dir))
    return splits.splits(a, b, T.days, T.amount)


@query(f"WITH RECURSIVE {_OUTCOMES} SELECT strategy, outcome, count(*) AS n FROM oc GROUP BY ALL UNION ALL SELECT 'SPLIT', kind, count(*) FROM sp GROUP BY ALL")
def reconcile_all_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes, found = matching.reconcile(*sides(spark, sf_dir))
    counts = outcomes.groupBy("strategy", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(found.groupBy(F.lit("SPLIT").alias("strategy"), F.col("kind").alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH RECURSIVE {_ALL} SELECT origin, uid, reason, discrepancy FROM every", columns="discrepancy")
def u6_all_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_run(spark, sf_dir).exceptions.select("origin", "uid", "reason", "discrepancy")


@query(f"WITH RECURSIVE {_ALL} SELECT uid, reason FROM every WHERE origin = 'source'")
def d1_exceptions_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_run(spark, sf_dir).exceptions.where("origin = 'source'").select("uid", "reason")


@query(f"WITH RECURSIVE {_ALL} SELECT uid, reason FROM every WHERE origin = 'counterpart'")
def d2_exceptions_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_run(spark, sf_dir).exceptions.where("origin = 'counterpart'").select("uid", "reason")


@query(f"WITH RECURSIVE {_ALL}, h AS (SELECT reason, count(*) AS n, max(discrepancy) AS most FROM every GROUP BY 1), t AS (SELECT record_id FROM every ORDER BY discrepancy DESC NULLS LAST, origin, uid LIMIT 3) SELECT 'reason' AS what, reason AS name, n FROM h UNION ALL SELECT 'top', record_id, 1 FROM t")
def a17_reason_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions by reason, and the three at which most is at stake."""
    rows = whole_run(spark, sf_dir).exceptions
    counts = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reason").alias("what"), F.col("reason").alias("name"), "n")
    top = search.page(rows, [F.desc_nulls_last("discrepancy"), F.col("origin"), F.col("uid")], 3)
    return counts.unionByName(top.select(F.lit("top").alias("what"), F.col("record_id").alias("name"), F.lit(1).cast("long").alias("n")))


@query(f"WITH RECURSIVE {_ALL} SELECT origin, uid, reason FROM every WHERE reason = 'AMOUNT_MISMATCH'")
def f2_exception_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.given(whole_run(spark, sf_dir).exceptions, reason="AMOUNT_MISMATCH", origin="ALL", uid=None).select("origin", "uid", "reason")


@query(f"WITH RECURSIVE {_ALL} SELECT origin, uid, reason, (SELECT count(*) FROM every) AS total FROM every ORDER BY uid DESC, origin LIMIT 200 OFFSET 10")
def k2_exceptions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.counted_page(whole_run(spark, sf_dir).exceptions.select("origin", "uid", "reason"), [F.desc("uid"), F.col("origin")], 200, 10)


@query(f"WITH RECURSIVE {_ALL} SELECT origin, uid, reason, discrepancy FROM every ORDER BY discrepancy DESC NULLS LAST, origin, uid LIMIT 500", columns="discrepancy")
def k3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exceptions at which most is at stake; asked for more than the cap, 500 come."""
    rows = whole_run(spark, sf_dir).exceptions
    return search.page(rows, [F.desc_nulls_last("discrepancy"), F.col("origin"), F.col("uid")], search.capped(900)).select("origin", "uid", "reason", "discrepancy")


@query(f"WITH RECURSIVE {_ALL} SELECT kind, origin, uid FROM (SELECT 'material' AS kind, * FROM every UNION ALL SELECT 'ambiguous', * FROM every WHERE reason = 'AMBIGUOUS_CANDIDATE_CONFLICT' UNION ALL SELECT 'unresolved', * FROM every WHERE reason IN ('MISSING_COUNTERPART', 'UNRECORDED_TRANSACTION'))")
def f6_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material, ambiguous and unresolved exceptions, of all passes and both sides."""
    rows = whole_run(spark, sf_dir).exceptions
    parts = {"material": search.given(rows, level="MATERIAL"), "ambiguous": search.given(rows, reason="AMBIGUOUS_CANDIDATE_CONFLICT"), "unresolved": rows.where(F.col("reason").isin(*run.LAST.values()))}
    out = None
    for kind, part in parts.items():
        part = part.select(F.lit(kind).alias("kind"), "origin", "uid")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH RECURSIVE {_OUTCOMES} SELECT record_id FROM oc JOIN a ON a.uid = uid_a WHERE outcome IN {_MATCH} UNION SELECT record_id FROM oc JOIN b ON b.uid = uid_b WHERE outcome IN {_MATCH}")
def u5_matched_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.reconcile(*sides(spark, sf_dir))[0].where("is_match")
    return pairs.select(F.explode(F.array("record_id_a", "record_id_b")).alias("record_id")).distinct()


_COUNTS = f"""c1 AS (SELECT count(*) AS n FROM a JOIN b USING (canonical_id) WHERE canonical_id <> ''), c2 AS (SELECT count(*) AS n FROM a1 JOIN b1 USING (clean_ref) WHERE clean_ref <> ''),
 n3 AS (SELECT count(*) AS n FROM a2 x JOIN b2 y ON x.amount = y.amount OR x.net_amount = y.net_amount), n4 AS (SELECT count(*) AS n FROM a3 x JOIN b3 y ON x.entity = y.entity WHERE x.amount IS NOT NULL AND y.amount IS NOT NULL),
 k AS (SELECT count(*) FILTER (outcome IN {_MATCH}) AS matches, count(*) FILTER (outcome = 'EXACT_MATCH') AS exact, count(*) FILTER (outcome IN {_MATCH} AND best <= 1) AS normal, count(*) AS n, sum(CASE WHEN outcome IN {_MATCH} THEN amount_a END) AS volume,
   sum(CASE WHEN outcome IN {_MATCH} THEN best END) AS differences FROM oc)"""


@query(
    f"""WITH RECURSIVE {_ALL}, {_COUNTS}, e AS (SELECT count(*) AS n, sum(discrepancy) AS total FROM every)
    SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, (SELECT sum(amount) FROM a) AS total_a, (SELECT sum(amount) FROM b) AS total_b, k.matches, k.exact, k.matches - k.exact AS fuzzy, k.normal, e.n AS material, (SELECT count(*) FROM sp) AS n_splits,
     round(100.0 * k.matches / (SELECT count(*) FROM a), 1) AS match_rate, k.volume AS matched_volume, k.differences + e.total AS discrepancy_volume FROM k, e""",
    columns="total_a total_b matched_volume discrepancy_volume",
)
def a6_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = whole_run(spark, sf_dir).totals
    names = {"rows_a": "source_population", "rows_b": "counterpart_population", "total_a": "total_primary", "total_b": "total_counterparty", "matches": "matched_records", "exact": "exact_matches", "fuzzy": "fuzzy_matches", "normal": "normal_discrepancies", "material": "material_discrepancies", "n_splits": "splits", "match_rate": "match_rate", "matched_volume": "matched_volume", "discrepancy_volume": "total_discrepancy"}
    money = ("total_a", "total_b", "matched_volume", "discrepancy_volume")
    kinds = ", ".join(f"{c} {'decimal(38,2)' if c in money else 'double' if c == 'match_rate' else 'long'}" for c in names)
    return spark.createDataFrame([tuple(t[c] for c in names.values())], kinds)


@query(
    f"""WITH RECURSIVE {_ALL}, {_COUNTS}, r AS (SELECT outcome, count(*) AS n FROM oc GROUP BY 1), of_(name, n) AS (
     SELECT 'amount_mismatch', (SELECT coalesce(sum(n), 0) FROM r WHERE outcome = 'AMOUNT_MISMATCH') UNION ALL SELECT 'date_mismatch', (SELECT n FROM n3) - (SELECT count(*) FROM c3) UNION ALL SELECT 'currency_mismatch', (SELECT coalesce(sum(n), 0) FROM r WHERE outcome = 'CURRENCY_MISMATCH')
     UNION ALL SELECT 'missing_counterpart', (SELECT count(*) FROM a) + (SELECT count(*) FROM b) - 2 * (SELECT n FROM k) UNION ALL SELECT 'ambiguous_candidate_conflict', (SELECT coalesce(sum(n), 0) FROM r WHERE outcome IN ('DUPLICATE_TRANSACTION', 'AMBIGUOUS_CANDIDATE_CONFLICT')) + (SELECT count(*) FROM s4 WHERE da > 1 OR db > 1)
     UNION ALL SELECT 'missing_amount', (SELECT coalesce(sum(n), 0) FROM r WHERE outcome = 'MISSING_AMOUNT') UNION ALL SELECT 'invalid_record', 0 UNION ALL SELECT 'candidate_pairs', (SELECT n FROM c1) + (SELECT n FROM c2) + (SELECT n FROM n3) + (SELECT n FROM n4))
    SELECT name, CAST(n AS BIGINT) AS n FROM of_"""
)
def a9_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven counters of rejected rows and pairs over all passes, and the pairs that were compared."""
    done = whole_run(spark, sf_dir)
    return spark.createDataFrame([*done.counters.items(), ("candidate_pairs", done.totals["candidate_pairs_evaluated"])], "name string, n long")


@query(
    f"""WITH RECURSIVE {_ALL}, w AS (SELECT record_id AS id FROM a UNION SELECT record_id FROM b UNION SELECT 'NONE-1'),
    t AS (SELECT record_id AS id, 0 AS l FROM oc JOIN a ON a.uid = uid_a WHERE outcome IN {_MATCH} UNION ALL SELECT record_id, 0 FROM oc JOIN b ON b.uid = uid_b WHERE outcome IN {_MATCH}
     UNION ALL SELECT record_id, 1 FROM every UNION ALL SELECT record_id, 2 FROM a UNION ALL SELECT record_id, 2 FROM b),
    c AS (SELECT id, l, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT id, min(l) AS l, arg_min(n, l) AS n FROM c GROUP BY 1)
    SELECT w.id, CASE s.l WHEN 0 THEN 'matches' WHEN 1 THEN 'exceptions' WHEN 2 THEN 'records' END AS stage, CASE WHEN s.l IS NULL THEN 'NOT_FOUND' WHEN s.n > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS status FROM w LEFT JOIN s ON s.id = w.id"""
)
def f4_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record id of both sides, and one that is in none, over matches, exceptions and records of a run."""
    a, b = sides(spark, sf_dir)
    done = run.run(a, b, T)
    ids = lambda df, c="record_id": df.select(F.col(c).alias("id"))
    pairs, records = done.outcomes.where("is_match"), ids(a).unionByName(ids(b))
    wanted = records.distinct().unionByName(spark.createDataFrame([("NONE-1",)], "id string"))
    return search.look_up([("matches", ids(pairs, "record_id_a").unionByName(ids(pairs, "record_id_b"))), ("exceptions", ids(done.exceptions)), ("records", records)], wanted)
