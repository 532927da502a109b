"""Ledger, bank and other financial views over the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

# The texts below run unchanged in Spark and in DuckDB.
LEDGER_SQL = """
SELECT 'TXN-'||CAST(o.o_orderkey AS STRING) AS record_id, 'INV-'||CAST(o.o_orderkey AS STRING) AS reference_id,
 CAST(o.o_orderdate AS DATE) AS dt, c.c_name AS entity, CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount,
 CASE o.o_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'INR' END AS currency, o.o_orderkey AS k
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""
BANK_SQL = """
SELECT 'BNK-'||CAST(k AS STRING)||CASE WHEN copy_no=0 THEN '' ELSE '-D' END AS record_id,
 CASE WHEN k%20=3 THEN 'REF#'||CAST(k AS STRING)||'/AUTO' WHEN k%20 IN (11,13,14,15,16) THEN 'Z'||CAST(k*10+copy_no+900000000 AS STRING) ELSE reference_id END AS reference_id,
 date_add(dt, CASE WHEN k%20 IN (4,13) THEN 1 WHEN k%20=6 THEN 7 WHEN k%20=11 THEN 400 ELSE 0 END) AS dt, entity,
 CASE WHEN k%20=9 THEN NULL WHEN k%20=16 AND copy_no=0 THEN CAST(100.00 AS DECIMAL(18,2)) WHEN k%20=16 THEN CAST(amount-CAST(100.00 AS DECIMAL(18,2)) AS DECIMAL(18,2))
  ELSE CAST(amount + CAST(CASE k%20 WHEN 1 THEN -0.03 WHEN 2 THEN -1.25 WHEN 5 THEN -15.00 WHEN 10 THEN 5.00 WHEN 15 THEN -2.00 WHEN 11 THEN 777.77 ELSE 0.00 END AS DECIMAL(18,2)) AS DECIMAL(18,2)) END AS amount,
 CASE WHEN k%20=8 THEN CASE currency WHEN 'USD' THEN 'EUR' ELSE 'USD' END ELSE currency END AS currency,
 CAST(CASE WHEN k%20=10 THEN 5.00 ELSE 0.00 END AS DECIMAL(18,2)) AS fee_amount, k, copy_no
FROM {ledger} CROSS JOIN (SELECT 0 AS copy_no UNION ALL SELECT 1) n
WHERE k%20<>7 AND (copy_no=0 OR k%20 IN (12,14,16))
"""
TAX_SQL = """
SELECT 'LN-'||CAST(l_orderkey AS STRING)||'-'||CAST(l_linenumber AS STRING) AS record_id, (l_orderkey + l_linenumber) % 11 AS v,
 CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS amount, CAST(l_tax AS DECIMAL(6,4)) AS rate,
 CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(6,4)) AS DECIMAL(18,2)) AS own_tax,
 CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) * CAST(0.18 AS DECIMAL(6,4)) AS DECIMAL(18,2)) AS usual_tax
FROM {lineitem}
"""
# Raw records of every kind of tax line, by v. This text is Spark's alone: raw records are maps of texts.
RAW_TAX_SQL = """
SELECT record_id, amount, CASE v
 WHEN 0 THEN map('amount', CAST(amount AS STRING))
 WHEN 1 THEN map('taxable_amount', CAST(amount AS STRING), 'tax_amount', CAST(own_tax AS STRING), 'tax_rate', CAST(rate AS STRING))
 WHEN 2 THEN map('subtotal', CAST(amount AS STRING), 'gst', CAST(NULL AS STRING), 'tax_rate', '8')
 WHEN 3 THEN map('taxable_amount', '0', 'tax', '0.00', 'note', 'Zero rated goods')
 WHEN 4 THEN map('taxable_amount', '0', 'tax', '0')
 WHEN 5 THEN map('net_amount', CAST(amount AS STRING), 'vat', CAST(usual_tax + 10 AS STRING))
 WHEN 6 THEN map('taxable_base', CAST(amount AS STRING), 'tax', CAST(usual_tax AS STRING), 'total', CAST(amount + usual_tax + 5 AS STRING))
 WHEN 7 THEN map('taxable_amount', 'n/a', 'amount', CAST(amount AS STRING), 'cgst', CAST(own_tax + CAST(0.04 AS DECIMAL(4,2)) AS STRING), 'gst_rate', CAST(rate AS STRING))
 WHEN 8 THEN map('base_amount', CAST(-amount AS STRING), 'tax', '5')
 WHEN 10 THEN map('withholding_tax', CAST(usual_tax AS STRING)) END AS raw
FROM {tax_lines}
"""
CASH_SQL = """
SELECT CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS inflow, CAST(0 AS DECIMAL(18,2)) AS outflow FROM {orders}
UNION ALL
SELECT CAST(l_shipdate AS DATE), CAST(0 AS DECIMAL(18,2)), CAST(l_extendedprice AS DECIMAL(18,2)) FROM {lineitem} WHERE l_returnflag = 'R'
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("orders", "customer", "lineitem") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: read(spark, sf_dir, n) for n in names})


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, LEDGER_SQL)


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BANK_SQL, ledger=ledger(spark, sf_dir))


def tax_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_TAX_SQL, tax_lines=_view(spark, sf_dir, TAX_SQL))


def cash_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CASH_SQL)


def normal_rows(rows: DataFrame, source: str) -> DataFrame:
    """Matcher rows of a ledger-like frame (record_id, reference_id, dt, entity, amount, currency, k and
    perhaps fee_amount and copy_no). uid orders rows by key and copy."""
    copy = F.col("copy_no") if "copy_no" in rows.columns else F.lit(0)
    fee = F.coalesce("fee_amount", F.lit(0)) if "fee_amount" in rows.columns else F.lit(0)
    zero = F.lit(0).cast(S.MONEY)
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")  # a small file is one task's, and cleaning is most of the work
    return rows.select(
        (F.col("k") * 2 + copy).alias("uid"), "record_id", S.canonical_id(F.col("reference_id")).alias("canonical_id"), S.core_id(F.col("reference_id")).alias("clean_ref"), "dt", "amount",
        S.net_amount(F.col("amount"), fee.cast(S.MONEY), zero, zero).alias("net_amount"), fee.cast(S.MONEY).alias("fee_amount"), "currency",
        S.entity_name(F.col("entity")).alias("entity"), F.lit(source).alias("source"),
    )


def sql_views(*names: str) -> str:
    """WITH parts for DuckDB: the views named, over the plain tables."""
    plain = {"orders": "orders", "customer": "customer", "lineitem": "lineitem", "ledger": "ledger"}
    texts = {"ledger": LEDGER_SQL, "bank": BANK_SQL, "tax_lines": TAX_SQL, "cash_flows": CASH_SQL}
    return ", ".join(f"{n} AS ({texts[n].format(**plain)})" for n in names)
