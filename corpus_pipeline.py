"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import exact_dedup, packing, pii, setsketch, toxicity
from tallyspark.llm.common import forget, materialise, remainder, table, written
from tallyspark.llm.queries import tokenizer_file


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the rows of `labels` that
    op10_toxicity learns from.

    Null and empty texts have no hits and stay, as do rows of a null id; texts are read whole. Repeated
    rows and rows that share a text stay or go together. A score at the threshold is toxic. An empty
    table stays empty, and other columns, whatever their names, are handed on."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), may_learn=remainder("doc_id", 5) != 0)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, the one with the largest id stays.

    Null and empty texts are one group. Rows of a null id stay; rows that repeat the largest id of their
    group stay together. Texts of any length are compared whole. An empty table stays empty, and
    other columns are handed on."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles, the one with
    the smallest id stays.

    Null, empty and blank texts have no shingles and stay, as do rows of a null id; rows that repeat an
    id stay or go together. Texts of any length count whole. An empty table stays empty, and other
    columns are handed on."""
    return setsketch.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; n_chars, if there, follows the text.

    Null texts stay null, with a null n_chars, and empty ones empty; every row stays, repeated ones and
    those of a null id too. Of overlapping spans the first names the whole. Texts of any length
    are read whole. An empty table stays empty, and other columns are handed on."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, placed in sequences of at most 2048.

    A null text counts as empty and is one token; repeated rows are documents each, and a null id is kept as
    it is. Longer documents are cut, of any length. Equal pieces are interchangeable, so ties change
    nothing but numbers. An empty table gives no pieces; other columns are ignored."""
    return packing.pack(docs, tokenizer_file(spark, "word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_documents),
    ("exact dedup", exact_duplicates),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the learned stages; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`. Each stage's rows are written and read again; then what the
    stage and the one before it have left in the shared folder is deleted."""
    docs = table(spark, sf_dir, "documents")
    known = written(spark)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline")
        forget(spark, known | {docs.stage_path})
    return STAGES[-1][1](spark, docs, sf_dir)
