"""Queries of the financial operators over the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .functions import similarity
from .operators import finance, forecast, matching, search
from .plans import mapping
from .registry import ORACLES, QUERIES, query
from .sources import adapter, files
from .sources.adapter import read, sql_views

T = matching.Tolerances()


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return adapter.normal_rows(adapter.ledger(spark, sf_dir), "ledger"), adapter.normal_rows(adapter.bank(spark, sf_dir), "bank")


def kept_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides, kept: passes read them several times, and cleaning ids and names is most of the work."""
    a, b = (matching.dealt(side, "canonical_id") for side in sides(spark, sf_dir))
    return matching.checkpointed(a), matching.checkpointed(b)


def kept_ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides, kept, without what the pass by id doesn't read: cleaned references and names."""
    a, b = (side.drop("clean_ref", "entity") for side in sides(spark, sf_dir))
    return matching.checkpointed(a), matching.checkpointed(b)


def first_pass(a: DataFrame, b: DataFrame) -> DataFrame:
    return matching.key_pass(a, b, "canonical_id", matching.ID_STRATEGIES, T, (100, 98, 95), True)


def second_pass(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, rows left of a, rows left of b) of the reference pass after the id pass; nothing reads the
    `kept_sides` from then on."""
    first, second, x, y = matching.key_passes(a, b, T)
    matching.let_go(a, b, first)
    return second, x, y


# The same in SQL, step by step.
_ROWS = f"""{sql_views("ledger", "bank")},
 a AS (SELECT k * 2 AS uid, record_id, reference_id AS canonical_id, regexp_replace(reference_id, '[^0-9]', '', 'g') AS clean_ref, dt, amount, amount AS net_amount, currency, lower(replace(entity, '#', ' ')) AS entity FROM ledger),
 b AS (SELECT k * 2 + copy_no AS uid, record_id, reference_id AS canonical_id, regexp_replace(reference_id, '[^0-9]', '', 'g') AS clean_ref, dt, amount, CAST(amount - fee_amount AS DECIMAL(18,2)) AS net_amount, currency, lower(replace(entity, '#', ' ')) AS entity FROM bank),
 dup AS (SELECT canonical_id FROM a GROUP BY 1 HAVING count(*) > 1 UNION SELECT canonical_id FROM b GROUP BY 1 HAVING count(*) > 1)"""


def _zip(left: str, right: str, key: str, name: str, case: str) -> str:
    columns = ", ".join(f"{s}.{c} AS {c}_{s}" for s in "xy" for c in ("uid", "canonical_id", "dt", "amount", "net_amount", "currency"))
    ranked = lambda t: f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY uid) AS rk, count(*) OVER (PARTITION BY {key}) AS sz FROM {t} WHERE {key} <> '')"
    best = "CASE WHEN abs(amount_x - amount_y) <= 0.05 THEN abs(amount_x - amount_y) ELSE least(abs(net_amount_x - amount_y), abs(amount_x - net_amount_y), abs(net_amount_x - net_amount_y)) END"
    return f"""
 {name}_0 AS (SELECT {columns}, x.sz AS sz_x, y.sz AS sz_y FROM {ranked(left)} x JOIN {ranked(right)} y ON x.{key} = y.{key} AND x.rk = y.rk),
 {name}_1 AS (SELECT *, {best} AS best, coalesce(abs(dt_x - dt_y), 0) AS days FROM {name}_0),
 {name} AS (SELECT uid_x AS uid_a, uid_y AS uid_b, CASE WHEN amount_x IS NULL OR amount_y IS NULL THEN 'MISSING_AMOUNT' WHEN currency_x <> currency_y THEN 'CURRENCY_MISMATCH' {case}
   WHEN best = 0 AND days = 0 THEN 'EXACT_MATCH' WHEN best <= 2.50 THEN 'TOLERANCE_MATCH' ELSE 'AMOUNT_MISMATCH' END AS outcome, best, days, amount_x AS amount_a, abs(amount_x - amount_y) AS gross FROM {name}_1)"""


_PASS1 = _ROWS + "," + _zip("a", "b", "canonical_id", "p1", "WHEN canonical_id_x IN (SELECT canonical_id FROM dup) THEN 'DUPLICATE_TRANSACTION'")
_LEFT1 = _PASS1 + ", a1 AS (SELECT * FROM a WHERE uid NOT IN (SELECT uid_a FROM p1)), b1 AS (SELECT * FROM b WHERE uid NOT IN (SELECT uid_b FROM p1))"
_PASS2 = _LEFT1 + "," + _zip("a1", "b1", "clean_ref", "p2", "WHEN sz_x > 1 OR sz_y > 1 THEN 'AMBIGUOUS_CANDIDATE_CONFLICT'")
_LEFT2 = _PASS2 + ", a2 AS (SELECT * FROM a1 WHERE uid NOT IN (SELECT uid_a FROM p2)), b2 AS (SELECT * FROM b1 WHERE uid NOT IN (SELECT uid_b FROM p2))"
_SHOWN = ("uid_a", "uid_b", "outcome", "days_diff")
_EVIDENCE = ("best_diff", "gross_diff", "basis", "strategy", "confidence")


def _shown_sql(strategy: str, fee_strategy: str, exact: int, near: int, fee: int) -> str:
    by_fee = "outcome = 'TOLERANCE_MATCH' AND best > 0.05"
    return f"""uid_a, uid_b, outcome, days AS days_diff, best AS best_diff, gross AS gross_diff, CASE WHEN gross <= 0.05 THEN 'GROSS' ELSE 'NET' END AS basis, CASE WHEN {by_fee} THEN '{fee_strategy}' ELSE '{strategy}' END AS strategy,
 CASE WHEN outcome = 'EXACT_MATCH' THEN {exact} WHEN {by_fee} THEN {fee} WHEN outcome = 'TOLERANCE_MATCH' THEN {near} END AS confidence"""


# Scalar functions


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount FROM orders", columns="amount")
def n_amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("""CASE o_orderkey % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN concat('$', format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2)) WHEN 2 THEN concat('₹', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING))
        WHEN 3 THEN concat(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), ' USD') ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END""")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), S.optional_amount(text).alias("amount"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders", columns="day")
def n_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN date_format(o_orderdate, 'MMM d, yyyy') WHEN 2 THEN date_format(o_orderdate, 'y/M/d') WHEN 3 THEN date_format(o_orderdate, 'yyyy-M-d') ELSE 'soon' END")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), S.iso_date(text).alias("day"))


@query("SELECT c_custkey AS k, lower(replace(c_name, '#', ' ')) AS name FROM customer")
def n_entity_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), S.entity_name(F.concat("c_name", F.lit("  Pvt-Ltd"))).alias("name"))


@query(f"WITH {sql_views('ledger', 'bank')} SELECT record_id, regexp_replace(reference_id, '[^0-9]', '', 'g') AS clean, reference_id AS canonical FROM bank")
def n_ref_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.col("reference_id")
    return adapter.bank(spark, sf_dir).select("record_id", S.core_id(ref).alias("clean"), S.canonical_id(F.concat(F.lit(' "'), F.lower(ref), F.lit('" '))).alias("canonical"))


@query(f"WITH {sql_views('ledger')} SELECT record_id, currency FROM ledger")
def n_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("CASE WHEN currency = 'EUR' THEN '€' WHEN currency = 'GBP' THEN 'paid in gbp' WHEN currency = 'USD' THEN NULL ELSE currency END")
    return adapter.ledger(spark, sf_dir).select("record_id", S.currency(said).alias("currency"))


@query(f"WITH {sql_views('ledger', 'bank')} SELECT record_id, CAST(amount - fee_amount AS DECIMAL(18,2)) AS net FROM bank", columns="net")
def n_net_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast(S.MONEY)
    return adapter.bank(spark, sf_dir).select("record_id", S.net_amount(F.col("amount"), F.col("fee_amount"), none, none).alias("net"))


@query()
def n20_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, bank = (adapter.normal_rows(f(spark, sf_dir), n) for f, n in ((adapter.ledger, "ledger"), (adapter.bank, "bank")))
    side = lambda df, s: df.select(F.col("clean_ref").alias("key"), F.struct(F.col("canonical_id").alias("ref"), "clean_ref", "amount", F.col("dt").alias("day"), "currency", "entity").alias(s))
    scored = side(ledger, "a").join(side(bank, "b"), "key").withColumn("score", similarity.match_score("a", "b")).withColumn("verdict", similarity.verified("score"))
    return scored.groupBy("score.category", "verdict.status").agg(F.count(F.lit(1)).alias("n"), F.min("score.total").alias("low"), F.max("score.total").alias("high"))


def _redact_sql(text: str) -> str:
    for pattern, instead in S.REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{instead}', 'g')"
    return text


@query(f"SELECT conv_id, turn, {_redact_sql('text')} AS text FROM conversations")
def n25_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", S.redact(F.col("text")).alias("text"))


@query("SELECT event_type, CASE WHEN regexp_matches(upper(event_type), 'UPLOAD|DOCUMENT|INGEST') THEN 'INGESTION' WHEN regexp_matches(upper(event_type), 'RECONCIL|MATCH') THEN 'RECONCILIATION' WHEN regexp_matches(upper(event_type), 'EXCEPTION|REVIEW') THEN 'EXCEPTION' WHEN regexp_matches(upper(event_type), 'TAX') THEN 'TAX' WHEN regexp_matches(upper(event_type), 'FORECAST|CASH') THEN 'FORECAST' WHEN regexp_matches(upper(event_type), 'QUESTION|MESSAGE|ANSWER|QUERY') THEN 'QA' ELSE 'SYSTEM' END AS category, count(*) AS n FROM events GROUP BY ALL")
def n26_audit_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type", S.audit_category(F.col("event_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


# Sources and planning


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def s9_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


_ITEM_SUM = lambda i: f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT)) AS VARCHAR)"


@query(f"SELECT o_custkey % 50 AS dataset, sha256(CAST(count(*) AS VARCHAR) || ':' || {_ITEM_SUM(0)} || ':' || {_ITEM_SUM(1)} || ':' || {_ITEM_SUM(2)} || ':' || {_ITEM_SUM(3)}) AS fingerprint FROM (SELECT o_custkey, sha256(CAST(o_orderkey AS VARCHAR) || ':' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)) AS h FROM orders) GROUP BY 1")
def s10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), F.col("o_totalprice").cast(S.MONEY).cast("string"))
    return read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("dataset")).agg(files.multiset_hash(item).alias("fingerprint"))


@query("SELECT 'o_orderkey' AS \"column\", count(*) AS \"rows\", count(o_orderkey) AS filled, count(DISTINCT o_orderkey) AS \"distinct\" FROM orders UNION ALL SELECT 'o_orderpriority', count(*), count(o_orderpriority), count(DISTINCT o_orderpriority) FROM orders")
def p1_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.profile(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")).select("column", "rows", "filled", "distinct")


@query(f"WITH {sql_views('ledger', 'bank')}, x AS (SELECT DISTINCT reference_id AS k FROM ledger), y AS (SELECT DISTINCT reference_id AS k FROM bank), s AS (SELECT count(*) AS shared FROM x JOIN y USING (k)) SELECT (SELECT count(*) FROM x) AS keys_a, (SELECT count(*) FROM y) AS keys_b, shared, round(shared / least((SELECT count(*) FROM x), (SELECT count(*) FROM y)), 4) AS overlap FROM s")
def l3_key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.key_overlap(adapter.ledger(spark, sf_dir), "reference_id", adapter.bank(spark, sf_dir), "reference_id")


# Matching


@query(f"WITH {_PASS1} SELECT {_shown_sql('EXACT_TRANSACTION_ID', 'EXACT_TRANSACTION_ID_FEE_DELTA', 100, 98, 95)} FROM p1", columns="best_diff gross_diff")
def j1_pass1_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_pass(*kept_ids(spark, sf_dir)).select(*_SHOWN, *_EVIDENCE)


@query(f"WITH {_PASS2} SELECT {_shown_sql('FALLBACK_EXACT_REFERENCE', 'FALLBACK_REFERENCE_FEE_DELTA', 95, 95, 90)} FROM p2", columns="best_diff gross_diff")
def j2_pass2_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return second_pass(*kept_sides(spark, sf_dir))[0].select(*_SHOWN, *_EVIDENCE)


@query(f"WITH {_LEFT2} SELECT x.uid AS uid_a, y.uid AS uid_b, CASE WHEN x.amount = y.amount THEN 0 ELSE 1 END AS phase FROM a2 x JOIN b2 y ON abs(x.dt - y.dt) <= 3 AND (x.amount = y.amount OR x.net_amount = y.net_amount)")
def j3_amount_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = second_pass(*kept_sides(spark, sf_dir))
    return matching.amount_candidates(a, b, T).select("uid_a", "uid_b", "phase")


@query(f"WITH {_LEFT2} SELECT x.uid AS uid_a, y.uid AS uid_b FROM a2 x JOIN b2 y ON x.entity = y.entity AND abs(x.dt - y.dt) <= 3 WHERE least(abs(x.amount - y.amount), abs(x.net_amount - y.amount), abs(x.amount - y.net_amount), abs(x.net_amount - y.net_amount)) <= 2.50")
def j6_entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = second_pass(*kept_sides(spark, sf_dir))
    return matching.entity_candidates(a, b, T).select("uid_a", "uid_b")


@query(f"WITH {_ROWS}, n AS (SELECT canonical_id, count(*) AS n FROM a GROUP BY 1) SELECT b.uid, b.canonical_id, CASE WHEN n.n > 0 THEN 'JOINED' ELSE 'UNRESOLVED' END AS status, coalesce(nullif(b.amount, 0), nullif(k.fee_amount, 0), nullif(b.net_amount, 0), 0) AS adjustment FROM b JOIN bank k USING (record_id) LEFT JOIN n ON n.canonical_id = b.canonical_id", columns="adjustment")
def j8_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    return finance.enrichment(b, a)


@query(f"WITH {_LEFT1} SELECT uid, record_id FROM a1")
def j9_residual_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = kept_ids(spark, sf_dir)
    return matching.residual(a, first_pass(a, b), "a").select("uid", "record_id")


# Groups, sums and exceptions


@query(f"WITH {_ROWS} SELECT canonical_id, count(*) AS n, min(uid) AS first_uid FROM b GROUP BY 1 HAVING count(*) > 1")
def a1_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.duplicate_groups(sides(spark, sf_dir)[1], ["canonical_id"])


@query(f"WITH {_ROWS} SELECT clean_ref, amount, count(*) AS n, min(uid) AS first_uid FROM b WHERE amount IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1", columns="amount")
def a2_dup_ref_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.duplicate_groups(sides(spark, sf_dir)[1], ["clean_ref", "amount"])


_SOURCES3 = f"""{_ROWS}, u AS (SELECT uid, canonical_id, amount, currency, 'ledger' AS source, 0 AS no FROM a UNION ALL SELECT uid, canonical_id, amount, currency, 'bank', 1 FROM b
 UNION ALL SELECT uid, canonical_id, CASE WHEN uid % 10 = 0 THEN amount + 3 ELSE amount END, currency, 'payout', 2 FROM a WHERE uid % 6 <> 0),
 f AS (SELECT canonical_id, arg_min(coalesce(amount, -1), no * 1000000000000 + uid) AS first FROM u GROUP BY 1)"""


@query(
    f"""WITH {_SOURCES3}, g AS (SELECT u.canonical_id, count(*) AS n, count(DISTINCT source) AS n_sources, count(*) FILTER (amount IS NULL) AS nulls, count(DISTINCT currency) AS ccy, count(*) FILTER (abs(amount - f.first) > 0.05) AS off
     FROM u JOIN f USING (canonical_id) WHERE canonical_id <> '' GROUP BY 1)
     SELECT CASE WHEN n > n_sources THEN 'AMBIGUOUS' WHEN nulls > 0 THEN 'INVALID_RECORD' WHEN ccy > 1 THEN 'CURRENCY_MISMATCH' WHEN n_sources < 3 THEN 'MISSING_SOURCE' WHEN off = 0 THEN 'ALL_AGREE' WHEN off = 1 THEN 'ONE_DISAGREES' ELSE 'MULTIPLE_DISAGREE' END AS status, count(*) AS n_groups FROM g GROUP BY 1"""
)
def a4_multisource(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    third = a.where("uid % 6 != 0").withColumn("amount", F.expr("CAST(IF(uid % 10 = 0, amount + 3, amount) AS DECIMAL(18,2))")).withColumn("source", F.lit("payout"))
    rows = [df.withColumn("source_no", F.lit(i)) for i, df in enumerate((a, b, third))]
    agreed = finance.multi_source(rows[0].unionByName(rows[1]).unionByName(rows[2]), sources=3)
    return agreed.groupBy("status").agg(F.count(F.lit(1)).alias("n_groups"))



@query(f"WITH {sql_views('cash_flows')} SELECT day, sum(inflow) AS inflow, sum(outflow) AS outflow FROM cash_flows GROUP BY 1", columns="day inflow outflow")
def a12_daily_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.daily_flows(adapter.cash_flows(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {sql_views('cash_flows')}, d AS (SELECT day, CAST(sum(inflow) AS DOUBLE) AS x, CAST(year(day) AS INTEGER) AS period, row_number() OVER (PARTITION BY year(day) ORDER BY day) AS i FROM cash_flows GROUP BY day),
    r AS (SELECT period, i, x AS level FROM d WHERE i = 1 UNION ALL SELECT d.period, d.i, 0.3 * d.x + 0.7 * r.level FROM r JOIN d ON d.period = r.period AND d.i = r.i + 1)
    SELECT r.period, round(level, 4) AS level, r.i AS days FROM r JOIN (SELECT period, max(i) AS i FROM d GROUP BY 1) USING (period, i)"""
)
def a13_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.smoothed(finance.daily_flows(adapter.cash_flows(spark, sf_dir)), "inflow", F.year("day")).withColumn("level", F.round("level", 4))


@query(f"WITH {_PASS1} SELECT round(avg(days), 4) AS lag FROM p1 WHERE outcome IN ('EXACT_MATCH', 'TOLERANCE_MATCH')")
def a14_settlement_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_pass(*kept_ids(spark, sf_dir)).where("is_match").agg(F.round(F.avg("days_diff"), 4).alias("lag"))


@query(
    f"""WITH {_PASS1}, c AS (SELECT a.uid, CASE WHEN (a.uid // 2) % 20 IN (0, 1, 2, 4, 6, 10, 17, 18, 19) THEN a.uid END AS want, m.uid_b AS got FROM a LEFT JOIN p1 m ON m.uid_a = a.uid AND m.outcome IN ('EXACT_MATCH', 'TOLERANCE_MATCH')),
    k AS (SELECT CASE WHEN want IS NOT NULL AND want = got THEN 'TP' WHEN got IS NOT NULL THEN 'FP' WHEN want IS NOT NULL THEN 'FN' ELSE 'TN' END AS kind FROM c)
    SELECT count(*) FILTER (kind = 'TP') AS tp, count(*) FILTER (kind = 'FP') AS fp, count(*) FILTER (kind = 'FN') AS fn, count(*) FILTER (kind = 'TN') AS tn FROM k"""
)
def a15_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = kept_ids(spark, sf_dir)
    actual = first_pass(a, b).where("is_match").select(F.col("uid_a").alias("uid"), F.col("uid_b").alias("actual_target"))
    wanted = F.when(F.floor(F.col("uid") / 2).cast("long") % 20 == -1, 0)
    for case in (0, 1, 2, 4, 6, 10, 17, 18, 19):
        wanted = wanted.when(F.floor(F.col("uid") / 2).cast("long") % 20 == case, F.col("uid"))
    return finance.evaluate(a.select("uid", wanted.alias("expected_target")).join(actual, "uid", "left")).select("tp", "fp", "fn", "tn")



@query(f"WITH {sql_views('ledger', 'bank')} SELECT record_id, dt FROM bank ORDER BY dt DESC NULLS LAST, record_id LIMIT 50", columns="dt")
def k9_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(adapter.bank(spark, sf_dir), [F.desc_nulls_last("dt"), F.col("record_id")], 50).select("record_id", "dt")


#: Bank rows with signs of every direction of cash, in both engines.
_RECORDS = "CASE WHEN k % 13 = 0 THEN -amount ELSE amount END AS amount, CASE WHEN k % 5 = 1 THEN 'Gateway Fees' ELSE 'bank' END AS source, CASE WHEN k % 7 = 2 THEN 'Refund of order' END AS description, CASE WHEN k % 11 = 0 THEN NULL ELSE dt END AS day"
_CASH = f"{sql_views('ledger', 'bank')}, r AS (SELECT {_RECORDS} FROM bank), c AS (SELECT day, abs(coalesce(amount, 0)) AS x, coalesce(amount < 0, false) OR source LIKE '%Fee%' OR coalesce(description LIKE 'Refund%', false) AS goes FROM r)"


def cash_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.cash_records(adapter.bank(spark, sf_dir).selectExpr(*_RECORDS.split(", ")))


@query(f"WITH {_CASH} SELECT day, sum(CASE WHEN goes THEN 0 ELSE x END) AS inflow, sum(CASE WHEN goes THEN x ELSE 0 END) AS outflow FROM c WHERE day IS NOT NULL GROUP BY 1", columns="day inflow outflow")
def d10_cash_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.daily_flows(cash_rows(spark, sf_dir).where("day IS NOT NULL"))


@query(f"WITH {_CASH} SELECT sum(x) AS pending FROM c WHERE day IS NULL", columns="pending")
def d11_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cash_rows(spark, sf_dir).agg(F.sum("pending").cast("decimal(38,2)").alias("pending"))


@query(
    f"""WITH {_LEFT1}, {sql_views('cash_flows')}, u AS (SELECT sum(CASE WHEN amount >= 0 THEN amount ELSE 0 END) AS receivable, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS payable FROM a1), f AS (SELECT sum(inflow) AS i, sum(outflow) AS o FROM cash_flows)
    SELECT receivable, payable, CAST(round(CAST(receivable AS DOUBLE) * 365 / CAST(i AS DOUBLE), 2) AS DECIMAL(18,2)) AS dso, CAST(round(CAST(payable AS DOUBLE) * 365 / CAST(o AS DOUBLE), 2) AS DECIMAL(18,2)) AS dpo FROM u, f""", columns="receivable payable dso dpo")
def d16_working_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = kept_ids(spark, sf_dir)
    pairs = matching.checkpointed(first_pass(a, b).select("uid_a", "dt_a", "dt_b", "is_match"))  # read twice
    return finance.working_capital(matching.residual(a, pairs, "a"), adapter.cash_flows(spark, sf_dir), pairs.where("is_match")).select("receivable", "payable", "dso", "dpo")


# Tables, search and guards


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w5_latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.latest(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def k1_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(read(spark, sf_dir, "events"), [F.desc("ts"), F.col("event_id")], 50, 100).select("event_id", "user_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%E\\_1%' ESCAPE '\\' OR p_type ILIKE '%e\\_1%' ESCAPE '\\' OR p_brand ILIKE '%BRAND#1%'")
def f3_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    return rows.where(search.contains_any(["p_name", "p_type"], "e_1") | search.contains_any(["p_brand"], "brand#1")).select("p_partkey", "p_name")


@query("SELECT term, df, round(ln((SELECT count(*) + 1 FROM documents) / (df + 1)) + 1, 6) AS idf FROM (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents) GROUP BY 1)")
def a20_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_frequency(read(spark, sf_dir, "documents"), "doc_id", "text").select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    """WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents), h AS (SELECT * FROM t WHERE term IN ('license', 'version', 'reserved')), i AS (SELECT term, ln((SELECT count(*) + 1 FROM documents) / (count(*) + 1)) + 1 AS idf FROM h GROUP BY 1)
    SELECT doc_id AS id, round(sum(idf * CASE term WHEN 'license' THEN 2 ELSE 1 END), 6) AS score, CAST(sum(CASE term WHEN 'license' THEN 2 ELSE 1 END) AS BIGINT) AS n_terms FROM h JOIN i USING (term) GROUP BY 1 ORDER BY sum(idf * CASE term WHEN 'license' THEN 2 ELSE 1 END) DESC, n_terms DESC, doc_id LIMIT 10"""
)
def f5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), "doc_id", "text", "License version, LICENSE reserved")


def _guard_sql() -> str:
    found = lambda column, pattern: f"regexp_matches({column}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"
    steps = "".join(f" WHEN {found('plain', pattern)} THEN '{verdict}'" for verdict, pattern in search.injection_ladder())
    greetings = ", ".join(f"'{g}'" for g in search.GREETINGS)
    domain = f"trim(plain) IN ({greetings}) OR {found('trim(plain)', search.any_of(search.FINANCE_TERMS))} OR {found('text', search.RECORD_ID)} OR ({found('plain', search.ASKING)} AND {found('plain', search.OWN_DATA)})"
    return f"""WITH m AS (SELECT text, lower(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS plain FROM conversations)
    SELECT CASE WHEN trim(plain) = '' THEN 'EMPTY' WHEN length(text) > 4000 THEN 'TOO_LONG'{steps} WHEN {found('plain', search.any_of(search.OFF_TOPIC))} THEN 'OFF_TOPIC' WHEN {domain} THEN 'ALLOW' ELSE 'OFF_TOPIC' END AS verdict, count(*) AS n FROM m GROUP BY 1"""


@query(_guard_sql())
def f9_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy(search.guard(F.col("text")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(d.t, m.t) AS thread_id, coalesce(d.n, 0) AS n_documents, coalesce(m.n, 0) AS n_messages, r.latest_run FROM (SELECT doc_id % 40 AS t, count(*) AS n FROM documents GROUP BY 1) d FULL JOIN (SELECT conv_id AS t, count(*) AS n FROM conversations GROUP BY 1) m ON d.t = m.t FULL JOIN (SELECT user_id AS t, arg_max(event_id, (ts, event_id)) AS latest_run FROM events GROUP BY 1) r ON r.t = coalesce(d.t, m.t) WHERE coalesce(d.t, m.t) IS NOT NULL")
def a18_thread_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("thread_id"))
    messages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"))
    runs = read(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"))
    known = documents.select("thread_id").unionByName(messages.select("thread_id")).distinct()
    return search.thread_overview(documents, messages, runs).join(known, "thread_id", "left_semi")


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def u3_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u4_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query(f"WITH {_ROWS} SELECT 'ledger' AS source, count(*) AS n, sum(amount) AS total FROM a UNION ALL SELECT 'bank', count(*), sum(amount) FROM b", columns="total")
def j0_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    return a.unionByName(b).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


from . import outlook_queries, plan_queries, run_queries, store_queries  # noqa: E402, F401  (they register their queries)
