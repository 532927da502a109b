"""Tax lines from raw records: eligibility, choice of fields, status, severity, remedy, roll-up.

A raw record is a map of texts. A line is eligible if it has one of the tax keys, whatever its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import tax_severity

# Keys that make a record a tax line; keys of the base, the reported tax, the rate and the
# total, in order of choice; words of an exemption; remedies; the version of these rules.
TAX_KEYS = (
    "tax_amount", "tax", "gst", "vat", "tds", "cgst", "sgst", "igst", "tax_rate", "gst_rate", "vat_rate", "taxable_amount", "taxable_base", "tax_deducted", "withholding_tax", "sales_tax",
)
BASE_KEYS = ("taxable_amount", "taxable_base", "subtotal", "base_amount", "net_amount", "gross_amount", "amount")
REPORTED_KEYS = ("tax_amount", "tax", "gst", "vat", "tds", "withholding_tax", "tax_deducted", "cgst", "sgst", "igst")
RATE_KEYS = ("tax_rate", "rate", "gst_rate", "vat_rate")
TOTAL_KEYS = ("total", "total_amount", "invoice_total")
EXEMPT = ("exempt", "zero_rated", "zero rated", "exemption")
REMEDIES = {
    "MISMATCH": "Review the reported tax line against the taxable base; correct the invoice or obtain a credit note.",
    "MISSING": "A tax line is expected for this taxable base; obtain the missing tax invoice or withholding line.",
    "AMBIGUOUS": "Invoice total does not equal subtotal + tax; verify for additional fees, discounts, or a rounding error.",
}
RULES_VERSION = "1.0.0"
STATUSES = ("MATCH", "MISMATCH", "MISSING", "AMBIGUOUS", "TAX_DATA_UNAVAILABLE", "NOT_TAX_APPLICABLE")
NUMBER, CENTS = "decimal(28,8)", "decimal(38,2)"


def number(x: Column) -> Column:
    """A plain number from text; null for anything else."""
    return F.trim(x).try_cast(NUMBER)


def first_number(raw: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(number(F.try_element_at(raw, F.lit(k))) for k in keys))


def tax_lines(records: DataFrame, rate: str | None = None, tolerance: str = "0.05", assumed: str = "0.18") -> DataFrame:
    """A line for every record (record_id, amount, raw): taxable, rate, rate_source, expected, reported,
    difference, signed, status, severity, remedy, rules_version.

    The first of each list of keys that holds a number is taken; a base that no key has is the
    record's amount, or zero. A rate over 1 is in percent. The first that holds: not a tax line; a
    base under half a cent (a match only with words of an exemption and no tax); no tax where some
    is expected; a total that base and tax don't add up to; a tax within the tolerance; else a
    mismatch. Records of no map are no tax lines, and an empty table has no lines."""
    raw, tol = F.col("raw"), F.lit(tolerance).cast(CENTS)
    eligible = F.coalesce(F.exists(F.map_keys(raw), lambda k: k.isin(*TAX_KEYS)), F.lit(False))
    given = first_number(raw, RATE_KEYS)
    usual = F.lit(rate if rate is not None else assumed).cast(NUMBER)
    base = F.coalesce(first_number(raw, BASE_KEYS), F.col("amount").cast(NUMBER), F.lit(0).cast(NUMBER))
    lines = records.withColumns({
        "_eligible": eligible, "_base": base, "_tax": first_number(raw, REPORTED_KEYS), "_total": first_number(raw, TOTAL_KEYS),
        "_rate": F.coalesce(F.when(given > 1, given / 100).otherwise(given).cast(NUMBER), usual), "_source": F.when(given.isNotNull(), "SOURCE_DATA").otherwise("USER_CONFIGURED" if rate is not None else "ASSUMED"),
    })
    nothing = F.col("_base") < 0.005
    exact = lambda c: F.col(c).cast("decimal(38,8)")
    lines = lines.withColumn("_expected", F.when(nothing, 0).otherwise(F.round(F.col("_base") * F.col("_rate").cast("decimal(10,8)"), 2)).cast(CENTS))
    lines = lines.withColumn("_reported", F.coalesce("_tax", F.lit(0)).cast("decimal(38,8)"))
    said = F.lower(F.concat_ws(" ", F.map_keys("raw"), F.map_values("raw")))  # made for lines without base and tax only
    exempt = (F.col("_reported") == 0) & said.rlike("|".join(EXEMPT))
    off = F.abs(exact("_reported") - exact("_expected"))
    unsettled = F.coalesce(F.abs(exact("_total") - (exact("_base") + exact("_reported"))) > tol, F.lit(False))
    status = (
        F.when(~F.col("_eligible"), "NOT_TAX_APPLICABLE").when(nothing & exempt, "MATCH").when(nothing, "TAX_DATA_UNAVAILABLE").when((F.col("_reported") == 0) & (F.col("_expected") > 0), "MISSING")
        .when(unsettled, "AMBIGUOUS").when(off <= tol, "MATCH").otherwise("MISMATCH")
    )
    lines = lines.withColumn("status", status)
    held = lambda c: F.when(F.col("status") != "NOT_TAX_APPLICABLE", c)
    remedy = F.lit(None).cast("string")
    for name, text in REMEDIES.items():
        remedy = F.when(F.col("status") == name, text).otherwise(remedy)
    found = F.col("status").isin(*REMEDIES)
    cents = lambda c: held(F.round(c, 2).cast(CENTS))
    return lines.select(
        "record_id", "status", cents(F.col("_base")).alias("taxable"), held(F.col("_rate")).alias("rate"), held(F.col("_source")).alias("rate_source"), held(F.col("_expected")).alias("expected"), cents(F.col("_reported")).alias("reported"),
        cents(off).alias("difference"), cents(exact("_reported") - exact("_expected")).alias("signed"), F.when(found, tax_severity(off, F.col("_expected"))).alias("severity"), remedy.alias("remedy"), F.lit(RULES_VERSION).alias("rules_version"),
    )


def tax_rollup(lines: DataFrame) -> DataFrame:
    """One row: counts by status and severity, and over eligible lines their number, sums (null if there
    is none) and the share of matches, in percent."""
    eligible = F.col("status") != "NOT_TAX_APPLICABLE"
    by = [F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES] + [F.count_if(F.col("severity") == s).alias(f"severity_{s.lower()}") for s in ("HIGH", "MEDIUM", "LOW")]
    sums = [F.sum(F.when(eligible, F.col(c))).cast(CENTS).alias(f"total_{c}") for c in ("expected", "reported", "difference", "signed")]
    n = F.count_if(eligible)
    rate = F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.count_if(F.col("status") == "MATCH"), n), 2), F.lit(0.0))
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), n.alias("n_eligible"), *by, *sums, rate.alias("match_rate"))
