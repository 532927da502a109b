"""Queries over small tables of their own: no row, id or thread may be left out."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import functions as F

from tallyspark import queries
from tallyspark.functions import scalar


def test_thread_overview_has_runs_of_all_threads(spark, tmp_path):
    day = datetime.datetime(2026, 8, 1)
    tables = {
        "documents": ([(1, "x")], "doc_id long, text string"),
        "conversations": ([(50, 0, "user", "hi"), (51, 0, "user", "hi")], "conv_id long, turn int, role string, text string"),
        "events": ([(7, 50, day), (8, 50, day), (9, 1, day), (10, 77, day)], "event_id long, user_id long, ts timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.thread_id: (r.n_documents, r.n_messages, r.latest_run) for r in queries.QUERIES["a18_thread_overview"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 0, 9), 50: (0, 1, 8), 51: (0, 1, None)}


def test_redaction_keeps_rows_with_keys(spark, tmp_path):
    texts = ["key AIzaSyD9834273849234823948234 here", "lsv2_pt_0123456789abcdef", "sk-abcdefghij0123456789", "a risk-free answer_key", None]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.text for r in queries.QUERIES["n25_redact"](spark, str(tmp_path)).collect()}
    assert got == {0: "key [REDACTED_KEY] here", 1: "[REDACTED_KEY]", 2: "[REDACTED_KEY]", 3: "a risk-free [CONFIDENTIAL_BENCHMARK]", 4: None}


def test_passes_read_cleaned_rows_that_are_kept_and_spread(spark):
    data = "/root/testdata/sf0.001"
    a, _ = queries.sides(spark, data)
    assert a.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # one small file is no longer one task
    for name in ("j1_pass1_exact", "j2_pass2_reference", "j3_amount_candidates", "j6_entity_candidates"):
        plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan and "orders" not in plan, name


def test_company_endings_go_one_after_the_other(spark):
    names = ["Acme Pvt. Ltd.", "acme co inc", "Acme Ltd Pvt Ltd", "Acme Company Co", "Co", "ACME-CO", "Acme & Sons", " x  Private Limited ", "NaN", None]
    got = spark.createDataFrame([(k,) for k in names], "x string").select("x", scalar.entity_name(F.col("x")).alias("y")).collect()
    plain = {}
    for name in names:
        out = re.sub(r"[-_/\\#&.]+", " ", (name or "").strip(" ").lower())
        for ending in scalar.COMPANY_ENDINGS:
            out = out.removesuffix(f" {ending}")
        plain[name] = "" if (name or "").strip(" ").lower() == "nan" else " ".join(out.split())
    assert {r.x: r.y for r in got} == plain
