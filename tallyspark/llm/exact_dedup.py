"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries style summary (Spark's `approx_top_k`, a frequent-items sketch) names digests that may
be frequent. Their groups are then counted exactly, which takes one row per digest and task through
the shuffle, and the verified winners - at most `hot_keys` rows - are broadcast: rows of frequent
texts find their group on the map side and never meet in one task. All other digests are shuffled
in the ordinary way; each of them is rare, so no task gets a large group.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Frequent digests that are broadcast at most, and the counters of the summary.
HOT_KEYS = 512
TRACKED = 4096


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. `lower` does just that on texts of ASCII characters alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text; a null text counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_keys: int = HOT_KEYS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest id of a group stays. Null and
    empty texts are one group. Rows with a null id count in their group and are kept only if the
    whole group has null ids (keep_id null). Rows that repeat an id with an equal text are copies as
    well: they count, and all rows that carry the kept id are marked kept, since only the id tells
    rows apart. An empty table gives no rows; other columns are ignored."""
    digests = materialise(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256")), "digests")
    hot = digests.agg(F.expr(f"approx_top_k(text_sha256, {hot_keys}, {TRACKED})").alias("top"))
    hot = hot.select(F.explode("top").alias("top")).where(F.col("top.count") > 1).select(F.col("top.item").alias("text_sha256"))
    group = (F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = digests.join(F.broadcast(hot), "text_sha256", "left_semi").groupBy("text_sha256").agg(*group)
    winners = F.broadcast(materialise(winners, "winners"))  # hot_keys rows at most
    settled = digests.join(winners, "text_sha256")
    rare = digests.join(winners.select("text_sha256"), "text_sha256", "left_anti")
    rare = rare.join(rare.groupBy("text_sha256").agg(*group), "text_sha256")
    same = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    columns = ("doc_id", "keep_id", "group_size", same.alias("kept"), "text_sha256")
    return settled.select(*columns).unionByName(rare.select(*columns))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_keys: int = HOT_KEYS) -> DataFrame:
    """The rows of `docs` whose text has no copy with a larger id, with all their columns.

    Rows with a null id stay, as they cannot be told apart; rows that repeat an id are kept or
    dropped together. A text that only rows of a null id carry besides is not affected by them."""
    out = duplicate_groups(docs, id_col, text_col, hot_keys).where(~F.col("kept")).select(F.col("doc_id").alias("__tallyspark_dropped"))
    return docs.join(out.where(F.col("__tallyspark_dropped").isNotNull()).distinct(), F.col(id_col) == F.col("__tallyspark_dropped"), "left_anti")
