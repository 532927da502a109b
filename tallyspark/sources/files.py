"""Record files in and results out: CSV, JSON and binary sources, fingerprints, normalised records, sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from .workbooks import sheet_rows

MAX_BYTES = 25 * 1024 * 1024
EXTENSIONS = ("csv", "json", "xlsx", "xls")
# Aliases of each record field, the first that is filled counts.
ALIASES = {
    "record_id": ("record_id", "transaction_id", "txn_id", "payment_id", "id"), "reference_id": ("reference_id", "reference", "ref_no", "utr", "invoice_no"),
    "amount": ("amount", "transaction_amount", "total_amount", "net_amount", "value"), "date": ("date", "transaction_date", "txn_date", "value_date", "posting_date"),
    "entity": ("entity", "vendor", "merchant", "counterparty", "customer"), "description": ("description", "narration", "memo", "particulars"), "currency": ("currency", "ccy", "currency_code"),
}
RESERVED = {"con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10))}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; types come from the canonical parsers, not from a guess."""
    return spark.read.option("header", True).option("multiLine", True).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list, a single object, or an object that wraps its rows as `records`."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    return df.select(F.inline("records")) if df.columns == ["records"] else df


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of one workbook, or of all workbooks of a folder with one header: all columns as
    text. Each file is read in a task of its own, as a stream over its zipped parts; files over
    MAX_BYTES are left out, as they are refused on upload. The first row that has a cell is the header."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).where(F.col("length") <= MAX_BYTES)
    cells = raw.select("content").mapInPandas(sheet_rows, "head boolean, cells map<int,string>")
    heads = cells.where("head").select(F.array_sort(F.map_entries("cells")).alias("names")).distinct().collect()  # one header, as all files share it
    names = {e["key"]: e["value"] for r in heads for e in r["names"]}
    return cells.where("NOT head").select(*(F.try_element_at("cells", F.lit(k)).alias(name) for k, name in sorted(names.items())))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "json":
        return read_json(spark, path)
    if ending == "xlsx":
        return read_xlsx(spark, path)
    if ending == "csv":
        return read_csv(spark, path)
    raise ValueError(f"no reader for .{ending}")


def filename_problem(name: str) -> str | None:
    """Why a file name is refused, or None."""
    if not name.strip():
        return "EMPTY_FILENAME"
    if len(name) > 255:
        return "FILENAME_TOO_LONG"
    if re.search(r"[\x00-\x1f\x7f]", name):
        return "CONTROL_CHARACTERS"
    if "/" in name or "\\" in name or ".." in name:
        return "PATH_TRAVERSAL"
    if name.split(".")[0].lower() in RESERVED:
        return "RESERVED_NAME"
    return None if name.rsplit(".", 1)[-1].lower() in EXTENSIONS else "UNSUPPORTED_TYPE"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content_hash and problem of every file under a folder, in one distributed scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    zipped = F.substring("content", 1, 2) == F.lit(b"PK")
    problem = (
        F.when(F.col("length") == 0, "EMPTY_FILE").when(F.col("length") > MAX_BYTES, "OVERSIZED_FILE").when(~ending.isin(*EXTENSIONS), "UNSUPPORTED_TYPE")
        .when((ending == "xlsx") & ~zipped, "MALFORMED_FILE").when(ending.isin("csv", "json") & F.col("content").contains(F.lit(b"\x00")), "MALFORMED_FILE")
    )
    return raw.select("path", "length", F.sha2("content", 256).alias("content_hash"), problem.alias("problem"))


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose bytes the thread does not have yet; of equal new files the first path counts."""
    fresh = found.join(known.select("content_hash"), "content_hash", "left_anti")
    return fresh.groupBy("content_hash").agg(F.min_by(F.struct(*[c for c in found.columns if c != "content_hash"]), "path").alias("f")).select("content_hash", "f.*")


def normal_records(rows: DataFrame, source: str) -> DataFrame:
    """Ingest records: the first filled alias of each field, canonical forms, and an id made from the
    row where it has none. A missing amount counts as 0.00 here."""
    names = {c.strip().lower(): c for c in rows.columns}

    def first(field: str):
        have = [F.col(f"`{names[a]}`").cast("string") for a in ALIASES[field] if a in names]
        return F.coalesce(*[F.when(~S.is_missing(c), c) for c in have]) if have else F.lit(None).cast("string")

    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]))
    made = F.concat(F.lit("REC-"), F.substring(F.sha2(whole, 256), 1, 10))
    return rows.select(
        F.coalesce(first("record_id"), made).alias("record_id"), F.lit(source).alias("source"), S.amount(first("amount")).alias("amount"), S.currency(first("currency")).alias("currency"),
        S.iso_date(first("date")).alias("iso_date"), first("reference_id").alias("reference_id"), S.core_id(first("reference_id")).alias("clean_reference_id"), first("entity").alias("entity"),
        S.entity_name(first("entity")).alias("clean_entity"), S.clean_text(first("description")).alias("description"), whole.alias("raw_data"),
    )


#: Hexadecimal digits of an item's hash that one sum takes, and sums of a fingerprint.
DIGITS, SUMS = 15, 4


def multiset_hash(items: Column) -> Column:
    """An aggregate over texts that is equal for equal multisets, whatever their order: the number of items
    and four sums over parts of their SHA-256, hashed. Partial sums are merged, so no group is held."""
    parts = [F.conv(F.substring(F.sha2(items, 256), 1 + i * DIGITS, DIGITS), 16, 10).cast("decimal(20,0)") for i in range(SUMS)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("decimal(38,0)").cast("string") for p in parts]
    return F.sha2(F.concat_ws(":", F.count(items).cast("string"), *sums), 256)


def fingerprint(records: DataFrame, by: str) -> DataFrame:
    """One hash for the records of each document, whatever their order and headers."""
    item = F.to_json(F.struct("record_id", F.col("amount").cast("string").alias("amount"), "clean_reference_id", "iso_date", "clean_entity", "description"), {"ignoreNullFields": "false"})
    return records.groupBy(by).agg(multiset_hash(item).alias("fingerprint"), F.count(F.lit(1)).alias("records"))


def append(rows: DataFrame, path: str, partition: str = "thread_id") -> None:
    rows.write.mode("append").partitionBy(partition).parquet(path)


def publish(rows: DataFrame, path: str, run_id: str) -> None:
    """Write a run's rows to a folder of its own, then its manifest: readers see whole runs only."""
    rows.write.mode("overwrite").parquet(f"{path}/runs/{run_id}")
    rows.sparkSession.createDataFrame([(run_id,)], "run_id string").write.mode("overwrite").parquet(f"{path}/manifest/{run_id}")


def export_matches(pairs: DataFrame, path: str) -> None:
    columns = "uid_a uid_b record_id_a record_id_b amount_a amount_b dt_a dt_b outcome strategy confidence best_diff".split()
    pairs.select(*columns).write.mode("overwrite").option("header", True).csv(path)
