"""Duplicates, enrichment, multi-source agreement, cash flows, working capital and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MONEY, days_ratio


def duplicate_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of several rows that share non-empty keys and have an amount if that is a key."""
    filled = rows
    for k in keys:
        filled = filled.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first_uid")).where("n > 1")


def enrichment(extra: DataFrame, rows: DataFrame) -> DataFrame:
    """Each enrichment row joined to the matched population by canonical id: JOINED or UNRESOLVED, with
    the first adjustment that is not zero."""
    counts = rows.where("canonical_id != ''").groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n_rows"))
    adjustment = F.coalesce(*[F.when(F.col(c) != 0, F.col(c)) for c in ("amount", "fee_amount", "net_amount")], F.lit(0)).cast(MONEY)
    return extra.join(counts, "canonical_id", "left").select("uid", "canonical_id", F.when(F.col("n_rows") > 0, "JOINED").otherwise("UNRESOLVED").alias("status"), adjustment.alias("adjustment"))


def multi_source(rows: DataFrame, sources: int, tolerance: str = "0.05", outlier: str = "2.50") -> DataFrame:
    """Agreement of all sources on each canonical id. `source_no` orders the sources.

    The first that holds: a source has the id twice, an amount is missing, currencies differ, a source
    lacks it, all agree with the first source within the tolerance, one or several do not.

    Rows are first counted by id and source, so that lists hold one entry a source, however many rows
    an id has; a source that has it twice is compared by its first row."""
    each = rows.where("canonical_id != ''").groupBy("canonical_id", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("amount").isNull()).alias("n_null"), F.min("currency").alias("low"), F.max("currency").alias("high"), F.min(F.struct("source_no", "uid", "amount")).alias("entry"),
    )
    groups = each.groupBy("canonical_id").agg(
        F.sum("n").alias("n"), F.count("source").alias("n_sources"), F.sum("n_null").alias("n_null"), F.when(F.min("low") < F.max("high"), 2).otherwise(1).alias("n_currencies"),
        F.array_sort(F.collect_list("entry")).alias("entries"), F.percentile(F.col("entry.amount").cast("double"), 0.5).alias("median"),
    )
    first = F.element_at("entries", 1)["amount"]
    off = F.size(F.filter("entries", lambda e: F.abs(e["amount"] - first) > F.lit(tolerance).cast(MONEY)))
    status = (
        F.when(F.col("n") > F.col("n_sources"), "AMBIGUOUS").when(F.col("n_null") > 0, "INVALID_RECORD").when(F.col("n_currencies") > 1, "CURRENCY_MISMATCH")
        .when(F.col("n_sources") < sources, "MISSING_SOURCE").when(off == 0, "ALL_AGREE").when(off == 1, "ONE_DISAGREES").otherwise("MULTIPLE_DISAGREE")
    )
    apart = F.size(F.filter("entries", lambda e: F.abs(e["amount"].cast("double") - F.col("median")) > float(outlier)))
    return groups.select("canonical_id", "n", "n_sources", status.alias("status"), apart.alias("n_disagreeing"))


def daily_flows(flows: DataFrame) -> DataFrame:
    return flows.groupBy("day").agg(F.sum("inflow").cast("decimal(38,2)").alias("inflow"), F.sum("outflow").cast("decimal(38,2)").alias("outflow"))


def flows_out() -> Column:
    """Whether a record (amount, source, description) flows out: negative amounts, fees, refunds."""
    signs = ((F.col("amount") < 0), F.lower("source").contains("fee"), F.lower("description").contains("refund"))
    out = F.lit(False)
    for sign in signs:
        out = out | F.coalesce(sign, F.lit(False))
    return out


def cash_records(records: DataFrame) -> DataFrame:
    """day, inflow, outflow and pending of each record (amount, source, description, day). Negative
    amounts, fees by source and refunds by description flow out; a null amount is zero, and a record
    without a day is pending."""
    size, none, dated, out = F.abs(F.coalesce("amount", F.lit(0))).cast(MONEY), F.lit(0).cast(MONEY), F.col("day").isNotNull(), flows_out()
    part = lambda holds: F.when(holds, size).otherwise(none)
    return records.select("day", part(dated & ~out).alias("inflow"), part(dated & out).alias("outflow"), part(~dated).alias("pending"))


def stale_context(projection: DataFrame, today: str) -> DataFrame:
    """The last day before a projection, and whether it lies before `today`; one row, without an end and
    not stale if there is no projection."""
    end = F.date_sub(F.min("day"), 1)
    return projection.agg(F.lit(today).alias("analysis_date"), end.alias("window_end"), F.coalesce(end < F.lit(today).cast("date"), F.lit(False)).alias("stale"))


def working_capital(unmatched: DataFrame, flows: DataFrame, lag: DataFrame, days: int = 365) -> DataFrame:
    """Receivable and payable from unmatched amounts, DSO, DPO, no DIO, their partial cycle, and the
    average days between matched dates."""
    open_ = unmatched.agg(F.sum(F.expr("IF(amount >= 0, amount, 0)")).alias("receivable"), F.sum(F.expr("IF(amount < 0, -amount, 0)")).alias("payable"))
    total = flows.agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    waited = lag.agg(F.round(F.avg(F.abs(F.datediff("dt_a", "dt_b"))), 4).alias("settlement_lag"))
    dso, dpo = days_ratio(F.col("receivable"), F.col("inflow"), days), days_ratio(F.col("payable"), F.col("outflow"), days)
    one = open_.join(F.broadcast(total)).join(F.broadcast(waited))  # one row each
    return one.select("receivable", "payable", dso.alias("dso"), dpo.alias("dpo"), F.lit(None).cast(MONEY).alias("dio"), (dso - dpo).cast(MONEY).alias("ccc"), "settlement_lag")


def evaluate(cases: DataFrame) -> DataFrame:
    """Confusion counts and rates by category from (category, expected_target, actual_target, excepted)."""
    wanted = F.col("expected_target").isNotNull()
    right = F.coalesce(F.col("expected_target") == F.col("actual_target"), F.lit(False))
    kind = F.when(wanted & right, "TP").when(wanted & F.col("actual_target").isNotNull(), "FP").when(wanted, "FN").when(F.col("actual_target").isNotNull(), "FP").otherwise("TN")
    n = {k: F.count_if(F.col("kind") == k) for k in ("TP", "FP", "FN", "TN")}
    precision, recall = F.try_divide(n["TP"], n["TP"] + n["FP"]), F.try_divide(n["TP"], n["TP"] + n["FN"])
    return cases.withColumn("kind", kind).agg(
        *(v.alias(k.lower()) for k, v in n.items()), F.round(100 * precision, 2).alias("precision"), F.round(100 * recall, 2).alias("recall"),
        F.round(200 * F.try_divide(precision * recall, precision + recall), 2).alias("f1"), F.round(100 * (n["TP"] + n["TN"]) / F.count(F.lit(1)), 2).alias("accuracy"),
    )
