"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Columns of money and of days: results show them as doubles and as ISO texts, in both engines.
MONEY = "amount net best_diff gross_diff adjustment total total_a total_b variance total_expected total_reported total_difference total_signed matched_volume discrepancy_volume discrepancy expected reported difference opening inflow outflow receivable payable dso dpo diff balance in_flow out_flow pending".split()
DAYS = ["day"]


def query(sql: str | None = None, columns: str = ""):
    """Register a query under its function's name, with SQL that gives the same rows. `columns` names
    those that SQL has to cast as the query's result is."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            kinds = {"decimal": "double", "date": "string"}
            return df.withColumns({c: F.col(c).cast(kinds[kind.split("(")[0]]) for c, kind in df.dtypes if kind.split("(")[0] in kinds})

        QUERIES[f.__name__] = shown
        if sql:
            casts = ", ".join(f"CAST({c} AS {'DOUBLE' if c in MONEY else 'VARCHAR'}) AS {c}" for c in columns.split())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return f

    return add
