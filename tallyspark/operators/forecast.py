"""Cash forecasts from dated records: run rates or smoothing, pending money, balance, confidence.

History is one aggregation of the records by day, which is kept, so that several forecasts read it and not the
records. The rest stays lazy tables: what hangs on all of it is one row, and projections are that row
times the days of the horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import MONEY
from .common import checkpointed
from .finance import flows_out

WIDE = "decimal(38,2)"
# Weight of each weekday, from Monday; the methods; the share of a new day in the level.
WEEKDAY_WEIGHTS = (1.10, 1.05, 1.00, 1.00, 1.15, 0.40, 0.30)
METHODS = ("deterministic_dow_weighted_moving_average", "exponential_smoothing")
ALPHA = 0.3
#: Days on which pending money comes in, if they are weekdays, and days of one range of the scan.
RELEASE_DAYS, RANGE_DAYS = 2, 512


def smoothed(daily: DataFrame, value: str, by: Column | None = None, alpha: float = ALPHA) -> DataFrame:
    """period, level and days: the exponentially weighted level of each group after its last day.

    A day maps the level x to (1 - alpha) * x + alpha * v, the first one to v. Such maps are composed
    within ranges of days, each range to one map (a, b), and then from range to range, so that no
    task holds a group's days. Days without a value count as none; `by` null is one group."""
    days = daily.where(F.col(value).isNotNull()).select((F.lit(0) if by is None else by).alias("period"), F.col("day"), F.col(value).cast("double").alias("v"))
    days = days.withColumn("range", F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / RANGE_DAYS))
    keep = 1.0 - alpha
    later = F.count(F.lit(1)).over(Window.partitionBy("period", "range").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("weight", F.pow(F.lit(keep), later))  # at most RANGE_DAYS rows a range
    first = days.groupBy("period").agg(F.min("day").alias("first"))
    days = days.join(F.broadcast(first) if by is None else first, "period")  # one row if there is one group
    opens = F.col("day") == F.col("first")
    part = days.groupBy("period", "range").agg(
        F.when(F.bool_or(opens), 0.0).otherwise(F.pow(F.lit(keep), F.count(F.lit(1)))).alias("a"), F.sum(F.col("weight") * F.col("v") * F.when(opens, 1.0).otherwise(alpha)).alias("b"), F.count(F.lit(1)).alias("n"),
    )
    maps = F.array_sort(F.collect_list(F.struct("range", "a", "b")))  # a row for RANGE_DAYS days of the calendar
    level = F.aggregate(maps, F.lit(0.0), lambda x, m: m["a"] * x + m["b"])
    return part.groupBy("period").agg(level.alias("level"), F.sum("n").alias("days"))


def days_of(records: DataFrame) -> DataFrame:
    """Records (amount, source, description, day), counted and summed by day, and kept: the only time that they are
    read. A row for each day, and one for those without a day: n, inflow and outflow, each null without such a
    record, and pending. A record of nothing is an inflow of zero unless its marks make it an outflow."""
    out, size = flows_out(), F.abs(F.coalesce("amount", F.lit(0))).cast(MONEY)
    dated = F.col("day").isNotNull()
    sums = {"inflow": F.when(dated & ~out, size), "outflow": F.when(dated & out, size), "pending": F.when(~dated, size)}
    return checkpointed(records.groupBy("day").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).cast(WIDE).alias(name) for name, c in sums.items())))


def paid_days(matches: DataFrame) -> DataFrame:
    """The same of matches (amount_a, dt_a, dt_b): they flow in on either date; those without one are pending."""
    return days_of(matches.select(F.abs("amount_a").alias("amount"), *(F.lit(None).cast("string").alias(c) for c in ("source", "description")), F.coalesce("dt_a", "dt_b").alias("day")))


def history(days: DataFrame, paid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(daily, facts) of `days_of` records and `paid_days` of matches.

    daily: day, inflow and outflow, each null on days without such a record. facts, one row: n_records,
    n_matches, pending, first, last, n_inflow_days. If no record flows in on a dated day, the matches
    count as inflow."""
    paid = days.limit(0) if paid is None else paid
    counts = days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records")).join(F.broadcast(paid.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches"))))  # one row each
    sparse = days.agg((F.count("inflow") == 0).alias("sparse"))  # one row
    rows = days.unionByName(paid.join(F.broadcast(sparse)).where("sparse").drop("sparse"))
    daily = rows.where("day IS NOT NULL").groupBy("day").agg(F.sum("inflow").cast(WIDE).alias("inflow"), F.sum("outflow").cast(WIDE).alias("outflow"))
    pending = rows.agg(F.coalesce(F.sum("pending"), F.lit(0)).cast(WIDE).alias("pending"))
    of_days = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("inflow").alias("n_inflow_days"), *(F.coalesce(F.sum(c), F.lit(0)).cast(WIDE).alias(c) for c in ("inflow", "outflow")))
    return daily, counts.join(F.broadcast(pending)).join(F.broadcast(of_days))  # one row each


def outlook(records: DataFrame, horizon: int, *, matches: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """`outlook_of_days` of records and matches, each of which is read once."""
    check(horizon, options.get("method", METHODS[0]))
    return outlook_of_days(days_of(records), horizon, paid=None if matches is None else paid_days(matches), **options)


def check(horizon: int, method: str) -> None:
    if not 1 <= horizon <= 90:
        raise ValueError("horizon must lie between 1 and 90 days")
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")


def outlook_of_days(history_days: DataFrame, horizon: int, *, paid: DataFrame | None = None, opening: str | None = None, method: str = METHODS[0], today: str = "1970-01-01", n_exceptions: int = 0) -> tuple[DataFrame, DataFrame]:
    """(summary, projections) for `horizon` days (1 to 90) after the last dated day, or after `today` if
    there is none.

    Run rates are totals over the days with inflow, or over the span of days if none has any; smoothing
    takes the level of each flow instead. Weekdays weigh both. Half of what is pending comes in on
    each of the first two days that is a weekday. Without an opening balance the history's net flow
    is one. The summary has one row; its status is INSUFFICIENT_DATA, and there are no projections,
    if there is neither a record nor a match nor an exception."""
    check(horizon, method)
    daily, facts = history(history_days, paid)
    span = F.coalesce(F.datediff("last", "first") + 1, F.lit(1))
    level = lambda c: F.col(c).cast("double") / F.when(F.col("n_inflow_days") > 0, F.col("n_inflow_days")).otherwise(F.col("span_days"))
    facts = facts.withColumn("span_days", span)
    if method == METHODS[1]:
        for c in ("inflow", "outflow"):
            facts = facts.join(F.broadcast(smoothed(daily, c).agg(F.coalesce(F.round(F.max("level"), 2), F.lit(0.0)).alias(f"rate_{c}"))))  # one row
    else:
        facts = facts.withColumns({f"rate_{c}": level(c) for c in ("inflow", "outflow")})
    start = F.lit(opening).cast(WIDE) if opening is not None else (F.col("inflow") - F.col("outflow")).cast(WIDE)
    records_ = F.col("n_records")
    facts = facts.withColumns({
        "opening": start, "baseline_source": F.lit("USER_PROVIDED" if opening is not None else "HISTORY_DERIVED"),
        "status": F.when((records_ == 0) & (F.col("n_matches") == 0) & F.lit(n_exceptions == 0), "INSUFFICIENT_DATA").otherwise("COMPLETED"),
    })
    confident = F.when((F.col("span_days") >= 14) & (records_ >= 20), "HIGH").when((F.col("span_days") >= 5) | (records_ >= 6), "MEDIUM").otherwise("LOW")
    facts = facts.withColumn("confidence", F.when(F.col("status") == "COMPLETED", confident).otherwise("LOW"))
    summary = facts.select("status", "n_records", "span_days", "inflow", "outflow", "pending", "opening", "baseline_source", "confidence", F.lit(method).alias("method"))

    weights = F.array(*(F.lit(w) for w in WEEKDAY_WEIGHTS))
    days = facts.where("status = 'COMPLETED'").select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("i"))
    days = days.withColumn("day", F.date_add(F.coalesce("last", F.lit(today).cast("date")), F.col("i")))
    flow = lambda c: F.round(F.col(f"rate_{c}") * F.get(weights, F.weekday("day")), 2).cast(WIDE)
    release = F.when((F.col("i") <= RELEASE_DAYS) & (F.weekday("day") < 5), F.round(F.col("pending") / RELEASE_DAYS, 2)).otherwise(0).cast(WIDE)
    days = days.withColumns({"in_flow": (flow("inflow") + release).cast(WIDE), "out_flow": flow("outflow")})
    running = F.sum(F.col("in_flow") - F.col("out_flow")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))  # horizon rows at most
    return summary, days.select("day", "in_flow", "out_flow", (F.col("opening") + running).cast(WIDE).alias("balance"))
