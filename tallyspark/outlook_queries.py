"""Queries of tax lines and cash forecasts over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import finance, forecast, tax
from .queries import _CASH, _RECORDS
from .registry import query
from .sources import adapter
from .sources.adapter import sql_views

# Tax: what each kind of raw record (v) comes to.
_LINES = f"""{sql_views('tax_lines')}, p AS (SELECT record_id, v, amount, CAST(CAST(amount AS DECIMAL(18,2)) * CAST(0.08 AS DECIMAL(6,4)) AS DECIMAL(18,2)) AS eight, own_tax, usual_tax FROM tax_lines),
 x AS (SELECT record_id, v, CASE v WHEN 1 THEN own_tax WHEN 2 THEN eight WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN usual_tax WHEN 6 THEN usual_tax WHEN 7 THEN own_tax WHEN 8 THEN 0 WHEN 10 THEN usual_tax END AS expected,
  CASE v WHEN 1 THEN own_tax WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN usual_tax + 10 WHEN 6 THEN usual_tax WHEN 7 THEN own_tax + 0.04 WHEN 8 THEN 5 WHEN 10 THEN usual_tax END AS reported FROM p),
 s AS (SELECT *, abs(reported - expected) AS difference, CASE v WHEN 0 THEN 'NOT_TAX_APPLICABLE' WHEN 9 THEN 'NOT_TAX_APPLICABLE' WHEN 2 THEN 'MISSING' WHEN 4 THEN 'TAX_DATA_UNAVAILABLE' WHEN 8 THEN 'TAX_DATA_UNAVAILABLE' WHEN 5 THEN 'MISMATCH' WHEN 6 THEN 'AMBIGUOUS' ELSE 'MATCH' END AS status FROM x),
 l AS (SELECT *, CASE WHEN status NOT IN ('MISSING', 'MISMATCH', 'AMBIGUOUS') THEN NULL WHEN expected <= 0 THEN 'MEDIUM' WHEN difference >= 0.25 * expected THEN 'HIGH' WHEN difference >= 0.05 * expected THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tax.tax_lines(adapter.tax_records(spark, sf_dir))


@query(f"WITH {_LINES} SELECT record_id, status, severity, expected, reported, difference, CASE WHEN v IN (1, 2, 7) THEN 'SOURCE_DATA' WHEN status <> 'NOT_TAX_APPLICABLE' THEN 'ASSUMED' END AS rate_source FROM l", columns="expected reported difference")
def d8_tax_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("record_id", "status", "severity", "expected", "reported", "difference", "rate_source")


@query(
    f"""WITH {_LINES} SELECT status, severity, CASE status WHEN 'MISMATCH' THEN 'Review the reported tax line against the taxable base; correct the invoice or obtain a credit note.'
     WHEN 'MISSING' THEN 'A tax line is expected for this taxable base; obtain the missing tax invoice or withholding line.' WHEN 'AMBIGUOUS' THEN 'Invoice total does not equal subtotal + tax; verify for additional fees, discounts, or a rounding error.' END AS remedy, '1.0.0' AS rules_version, count(*) AS n FROM l GROUP BY ALL"""
)
def d9_tax_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("status", "severity", "remedy", "rules_version").agg(F.count(F.lit(1)).alias("n"))


_BY = ", ".join(f"count(*) FILTER (status = '{s}') AS \"{s.lower()}\"" for s in tax.STATUSES) + ", " + ", ".join(f"count(*) FILTER (severity = '{s}') AS severity_{s.lower()}" for s in ("HIGH", "MEDIUM", "LOW"))


@query(
    f"WITH {_LINES} SELECT count(*) AS n_lines, count(*) FILTER (status <> 'NOT_TAX_APPLICABLE') AS n_eligible, {_BY}, sum(expected) AS total_expected, sum(reported) AS total_reported, sum(difference) AS total_difference, sum(reported - expected) AS total_signed, round(100.0 * count(*) FILTER (status = 'MATCH') / count(*) FILTER (status <> 'NOT_TAX_APPLICABLE'), 2) AS match_rate FROM l",
    columns="total_expected total_reported total_difference total_signed",
)
def a11_tax_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tax.tax_rollup(lines(spark, sf_dir))


# Forecasts of 21 days, by both methods, without any inflow, and with matches in its place.
_SMOOTH = lambda c, flow: f"""{c}_{flow}_o AS (SELECT CAST(v AS DOUBLE) AS v, row_number() OVER (ORDER BY day) AS i FROM {c}_{flow}),
 {c}_{flow}_r(i, x) AS (SELECT i, v FROM {c}_{flow}_o WHERE i = 1 UNION ALL SELECT o.i, 0.3e0 * o.v + 0.7e0 * r.x FROM {c}_{flow}_r r JOIN {c}_{flow}_o o ON o.i = r.i + 1)"""  # noqa: E731
_WEIGHT = "CASE isodow(day) WHEN 1 THEN 1.1e0 WHEN 2 THEN 1.05e0 WHEN 5 THEN 1.15e0 WHEN 6 THEN 0.4e0 WHEN 7 THEN 0.3e0 ELSE 1e0 END"


def _case(name: str, rows: str, paid: str | None, smooth: bool) -> str:
    """CTEs that end with f_<name>: rows is a table of day, x (size) and goes."""
    inflow = f"SELECT day, sum(x) AS v FROM {paid} WHERE day IS NOT NULL GROUP BY 1" if paid else f"SELECT day, sum(x) AS v FROM {rows} WHERE NOT goes AND day IS NOT NULL GROUP BY 1"
    pending = " UNION ALL ".join(f"SELECT x FROM {t} WHERE day IS NULL" for t in (rows, *([paid] if paid else [])))
    rate = lambda flow: f"coalesce((SELECT round(x, 2) FROM {name}_{flow}_r ORDER BY i DESC LIMIT 1), 0e0)" if smooth else f"CAST(coalesce((SELECT sum(v) FROM {name}_{flow}), 0) AS DOUBLE) / CASE WHEN n > 0 THEN n ELSE span END"
    return f"""{name}_in AS ({inflow}), {name}_out AS (SELECT day, sum(x) AS v FROM {rows} WHERE goes AND day IS NOT NULL GROUP BY 1),
 {_SMOOTH(name, 'in')}, {_SMOOTH(name, 'out')},
 {name}_t AS (SELECT max(day) AS last, max(day) - min(day) + 1 AS span, (SELECT count(*) FROM {name}_in) AS n, coalesce((SELECT sum(x) FROM ({pending})), 0) AS pend, coalesce((SELECT sum(v) FROM {name}_in), 0) - coalesce((SELECT sum(v) FROM {name}_out), 0) AS start FROM (SELECT day FROM {name}_in UNION ALL SELECT day FROM {name}_out)),
 {name}_d AS (SELECT CAST(last + CAST(k AS INTEGER) AS DATE) AS day, k, pend, start, {rate('in')} AS ir, {rate('out')} AS orr FROM {name}_t, range(1, 22) r(k)),
 {name}_f AS (SELECT day, start, CAST(round(ir * {_WEIGHT}, 2) AS DECIMAL(18,2)) + CASE WHEN k <= 2 AND isodow(day) < 6 THEN CAST(round(pend / 2, 2) AS DECIMAL(18,2)) ELSE 0 END AS in_flow, CAST(round(orr * {_WEIGHT}, 2) AS DECIMAL(18,2)) AS out_flow FROM {name}_d),
 f_{name} AS (SELECT '{name}' AS forecast, day, in_flow, out_flow, start + sum(in_flow - out_flow) OVER (ORDER BY day) AS balance FROM {name}_f)"""


_PAID = "SELECT amount AS amount_a, CASE WHEN k % 3 = 0 THEN NULL ELSE dt END AS dt_a, CASE WHEN k % 6 = 0 THEN NULL ELSE date_add(dt, 1) END AS dt_b FROM {ledger}"
_FORECASTS = f"""{_CASH}, gone AS (SELECT day, x, true AS goes FROM c WHERE x > 0), m AS ({_PAID.format(ledger='ledger')}), paid AS (SELECT CAST(coalesce(dt_a, dt_b) AS DATE) AS day, abs(amount_a) AS x FROM m),
 {_case('average', 'c', None, False)}, {_case('smoothing', 'c', None, True)}, {_case('no_inflow', 'gone', None, False)}, {_case('matches', 'gone', 'paid', False)}"""


@query(f"WITH RECURSIVE {_FORECASTS} SELECT * FROM f_average UNION ALL SELECT * FROM f_smoothing UNION ALL SELECT * FROM f_no_inflow UNION ALL SELECT * FROM f_matches", columns="day in_flow out_flow balance")
def w1_forecast_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with and without dates by both methods, records that only flow out, and those with matches."""
    records = cash_records_of(spark, sf_dir)
    gone = records.where("amount IS NOT NULL").withColumn("amount", -F.abs("amount").cast("decimal(18,2)"))
    paid = forecast.paid_days(spark.sql(_PAID, ledger=adapter.ledger(spark, sf_dir)))
    records, gone = forecast.days_of(records), forecast.days_of(gone)
    cases = {"average": (records, {}), "smoothing": (records, {"method": forecast.METHODS[1]}), "no_inflow": (gone, {}), "matches": (gone, {"paid": paid})}
    out = None
    for name, (rows, options) in cases.items():
        days = forecast.outlook_of_days(rows, 21, **options)[1].select(F.lit(name).alias("forecast"), "day", "in_flow", "out_flow", "balance")
        out = days if out is None else out.unionByName(days)
    return out


def cash_records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.bank(spark, sf_dir).selectExpr(*_RECORDS.split(", "))


@query(
    f"WITH {_CASH}, n AS (SELECT count(*) AS n_records, CAST(max(day) - min(day) + 1 AS INTEGER) AS span_days, sum(CASE WHEN goes OR day IS NULL THEN 0 ELSE x END) AS inflow, sum(CASE WHEN goes AND day IS NOT NULL THEN x ELSE 0 END) AS outflow, sum(CASE WHEN day IS NULL THEN x ELSE 0 END) AS pending FROM c) SELECT 'COMPLETED' AS status, *, inflow - outflow AS opening, 'HISTORY_DERIVED' AS baseline_source, CASE WHEN span_days >= 14 AND n_records >= 20 THEN 'HIGH' WHEN span_days >= 5 OR n_records >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM n",
    columns="inflow outflow pending opening",
)
def w8_forecast_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.outlook(cash_records_of(spark, sf_dir), 7)[0].drop("method")


@query(f"WITH {sql_views('cash_flows')} SELECT '2026-01-01' AS analysis_date, max(day) AS window_end, max(day) < DATE '2026-01-01' AS stale FROM cash_flows", columns="window_end")
def w7_stale_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = adapter.cash_flows(spark, sf_dir)
    records = flows.select((F.col("inflow") - F.col("outflow")).cast("decimal(18,2)").alias("amount"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("description"), "day")
    return finance.stale_context(forecast.outlook(records, 7)[1], "2026-01-01")
