"""Canonical forms of amounts, dates, currencies, entities and ids, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
MISSING = ("", "nan", "none", "null", "n/a", "na", "-", "--", "inf", "+inf", "-inf")
# Date forms in the order in which they are tried.
DATE_FORMS = (
    "y-M-d", "y-M-d H:m:s", "y-M-d'T'H:m:s", "y-M-d'T'H:m:s.SSSSSS", "d/M/y", "M/d/y", "y/M/d", "d-M-y", "MMM d, y", "d MMM y", "MMMM d, y", "d MMMM y",
)
# Company endings, dropped one after the other in this order.
COMPANY_ENDINGS = ("pvt ltd", "pvt. ltd.", "private limited", "limited", "ltd", "inc", "corp", "llc", "llp", "gmbh", "co", "company")
# The same as one pattern: an ending that is dropped earlier stands further right.
_ENDINGS = "(?= )" + "".join(f"(?: {re.escape(e)})?" for e in reversed(COMPANY_ENDINGS)) + "$"
# Currency signs.
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "¥": "JPY"}


def is_missing(x: Column) -> Column:
    return x.isNull() | F.lower(F.trim(x)).isin(*MISSING)


def optional_amount(x: Column) -> Column:
    """Money from text, half up to cents; null if missing or no number. Zero is a value."""
    bare = F.regexp_replace(F.regexp_replace(x.cast("string"), r"[₹$€£¥,\s]", ""), r"[A-Za-z]+$", "")
    return F.when(~is_missing(x.cast("string")), bare.try_cast(MONEY))


def amount(x: Column) -> Column:
    """As `optional_amount`, with 0.00 for what is missing; only for ingest records."""
    return F.coalesce(optional_amount(x), F.lit(0).cast(MONEY))


def iso_date(x: Column) -> Column:
    """Date from text in the first form that fits, with a year of four digits, else a date of this
    century anywhere in it."""
    text = F.trim(x.cast("string"))
    whole_year = F.when(text.rlike(r"(?<!\d)\d{4}(?!\d)"), text)
    forms = [F.to_date(F.try_to_timestamp(whole_year, F.lit(form))) for form in DATE_FORMS]
    found = F.regexp_replace(F.regexp_extract(text, r"\b(20\d\d[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01]))\b", 1), "/", "-")
    return F.coalesce(*forms, found.try_cast("date"))


def entity_name(x: Column) -> Column:
    """Lower-case name without separators and company endings; empty if missing."""
    # One pattern for all endings: with twelve, the code that Spark makes of a row's cleaning passes 8,000 bytes, beyond which the JVM doesn't compile it.
    out = F.regexp_replace(F.lower(F.trim(F.coalesce(x.cast("string"), F.lit("")))), r"[-_/\\#&.]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, _ENDINGS, ""), r"\s+", " ")
    return F.when(F.lower(F.trim(x.cast("string"))) == "nan", "").otherwise(F.trim(out))


def core_id(x: Column) -> Column:
    """Digits of an id, all runs joined, without a known prefix and suffix; without digits the rest."""
    out = F.upper(F.trim(F.coalesce(x.cast("string"), F.lit(""))))
    out = F.regexp_replace(out, r"^(INV|REF|TXN|PAYOUT|ORD|ORDER|SETTLE|PAY)[-_#/:]*", "")
    out = F.regexp_replace(out, r"[-_#/:]*(AUTO|MANUAL|CLR)$", "")
    digits = F.regexp_replace(out, r"\D+", "")
    return F.when(F.upper(F.trim(x.cast("string"))) == "NAN", "").when(digits != "", digits).otherwise(F.trim(out))


def canonical_id(x: Column) -> Column:
    """Upper-case id without surrounding quotes and brackets; separators stay; empty if missing."""
    text = F.trim(x.cast("string"))
    bare = F.regexp_replace(text, "^['\"`()\\[\\]{}]+|['\"`()\\[\\]{}]+$", "")
    missing = text.isNull() | F.lower(text).isin("nan", "none", "null", "n/a", "")
    return F.when(missing, "").otherwise(F.upper(F.regexp_replace(bare, r"\s+", " ")))


def currency(x: Column) -> Column:
    """First three-letter word, else a sign's currency, else USD."""
    text = F.upper(F.trim(x.cast("string")))
    word = F.regexp_extract(text, r"\b([A-Z]{3})\b", 1)
    out = F.when(is_missing(text), "USD").when(word != "", word)
    for sign, code in CURRENCY_SIGNS.items():
        out = out.when(text.contains(sign), code)
    return out.otherwise("USD")


def clean_text(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s\-_/\\#]+", " ")))


def net_amount(gross: Column, fee: Column, refund: Column, chargeback: Column) -> Column:
    return (gross - F.coalesce(fee, F.lit(0)) - F.coalesce(refund, F.lit(0)) - F.coalesce(chargeback, F.lit(0))).cast(MONEY)


def missing_fields(ids: list[Column], amounts: list[Column]) -> Column:
    """Names of the required fields that no alias fills: record_id, amount."""
    lacks = [F.when(F.coalesce(*[F.when(~is_missing(c.cast("string")), F.lit(1)) for c in group]).isNull(), F.lit(name)) for name, group in (("record_id", ids), ("amount", amounts))]
    return F.array_compact(F.array(*lacks))


def fx_rate(source: Column, target: Column, rate: Column) -> Column:
    """1 between equal currencies, a given positive finite rate otherwise, else null: none is made up."""
    return F.when(source == target, F.lit(1.0)).when((rate > 0) & ~F.isnan(rate) & (rate < float("inf")), rate)


def fx_status(source: Column, target: Column, rate: Column) -> Column:
    return F.when(source == target, "NOT_REQUIRED").when(fx_rate(source, target, rate).isNotNull(), "CONVERTED").otherwise("CURRENCY_CONVERSION_REQUIRED")


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def same_id(a: Column, b: Column) -> Column:
    a, b = F.upper(F.trim(a)), F.upper(F.trim(b))
    return F.coalesce((a == b) & (a != ""), F.lit(False))


def amount_match(a: Column, b: Column, tolerance_cents: int) -> tuple[Column, Column]:
    """(within tolerance, absolute difference)."""
    diff = F.abs(a - b).cast(MONEY)
    return diff <= F.lit(tolerance_cents / 100).cast(MONEY), diff


def date_match(a: Column, b: Column, window_days: int) -> tuple[Column, Column]:
    """(within window, days apart); a missing date is 999 days off."""
    days = F.coalesce(F.abs(F.datediff(a, b)), F.lit(999))
    return (days <= window_days) & (days < 999), days


def currency_match(a: Column, b: Column) -> Column:
    return F.coalesce(F.upper(F.trim(a)) == F.upper(F.trim(b)), F.lit(True))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def identifier(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(x), "^[`'\"]+|[`'\"]+$", ""))


def tax_severity(difference: Column, expected: Column) -> Column:
    ratio = F.abs(difference) / expected
    return F.when(expected <= 0, "MEDIUM").when(ratio >= 0.25, "HIGH").when(ratio >= 0.05, "MEDIUM").otherwise("LOW")


def days_ratio(numerator: Column, denominator: Column, days: int) -> Column:
    """numerator / denominator * days to cents; null unless both are there and the denominator positive."""
    return F.when(denominator > 0, F.round(numerator.cast("decimal(18,2)") * days / denominator, 2).cast("decimal(18,2)"))


# What answers must never show, and what takes its place.
REDACTIONS = (
    (r"(?i)ground[_\s-]*truth(\.json)?", "[CONFIDENTIAL_BENCHMARK]"),
    (r"(?i)answer[_\s-]*key", "[CONFIDENTIAL_BENCHMARK]"),
    (r"AIza[0-9A-Za-z\-_]{20,50}", "[REDACTED_KEY]"),
    (r"lsv2_pt_[0-9A-Za-z\-_]{10,60}", "[REDACTED_KEY]"),
    (r"sk-[A-Za-z0-9\-_]{20,50}", "[REDACTED_KEY]"),
)


def redact(x: Column) -> Column:
    for pattern, instead in REDACTIONS:
        x = F.regexp_replace(x, pattern, instead)
    return x


def audit_category(action: Column) -> Column:
    """Group of an audit action by the first keyword it holds."""
    out = None
    for keywords, name in (("UPLOAD|DOCUMENT|INGEST", "INGESTION"), ("RECONCIL|MATCH", "RECONCILIATION"), ("EXCEPTION|REVIEW", "EXCEPTION"), ("TAX", "TAX"), ("FORECAST|CASH", "FORECAST"), ("QUESTION|MESSAGE|ANSWER|QUERY", "QA")):
        hit = F.upper(action).rlike(keywords)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("SYSTEM")


def recency(day: Column, today: Column) -> Column:
    days = F.datediff(today, day)
    return F.when(days <= 0, "TODAY").when(days == 1, "YESTERDAY").when(days <= 7, "PREVIOUS 7 DAYS").otherwise("EARLIER")
