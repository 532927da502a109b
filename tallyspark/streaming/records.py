"""Record streams: first arrivals only, and windowed flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals(stream: DataFrame, time: str, keys: list[str], late: str = "3 days") -> DataFrame:
    """Records whose keys have not come within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def flows(stream: DataFrame, time: str, kind: str, value: str, width: str = "1 day", late: str = "3 days") -> DataFrame:
    """Count and sum of each kind in each window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def matched_stream(source: DataFrame, counterpart: DataFrame, days: int = 3) -> DataFrame:
    """Pairs of equal canonical id whose times lie within the window, from two streams with columns
    canonical_id, ts and amount."""
    a = source.withWatermark("ts", f"{days} days").select(*(F.col(c).alias(f"{c}_a") for c in ("canonical_id", "ts", "amount")))
    b = counterpart.withWatermark("ts", f"{days} days").select(*(F.col(c).alias(f"{c}_b") for c in ("canonical_id", "ts", "amount")))
    near = F.expr(f"ts_b BETWEEN ts_a - INTERVAL {days} DAYS AND ts_a + INTERVAL {days} DAYS")
    return a.join(b, (F.col("canonical_id_a") == F.col("canonical_id_b")) & near)
