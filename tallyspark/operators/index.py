"""A stored inverted index, and pages of a stored order: both read only the part that a question needs."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import tokens

#: Buckets of terms; a bucket is a folder of postings in order of terms.
BUCKETS = 64
#: Ranges of a kept order that a task writes into one file.
RANGES_OF_FILE = 64


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


@dataclass
class SearchIndex:
    """Postings (term, id) and document frequencies, by bucket of the term, under one folder."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    def build(self, docs: DataFrame, id_col: str, text_cols: list[str]) -> SearchIndex:
        """Index every row by the distinct terms of its texts (null ones are empty). A term with very many
        rows is spread over the files of its bucket; counts are made before anything meets by term."""
        text = F.concat_ws(" ", *(F.col(c).cast("string") for c in text_cols))
        rows = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens(text))).alias("term"))
        rows = rows.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int"))
        spread = F.pmod(F.xxhash64("id"), F.lit(8))
        rows.repartition("bucket", spread).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings")
        counts = self.spark.read.schema(rows.schema).parquet(f"{self.root}/postings").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/terms")
        docs.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.root}/size")  # one row
        return self

    def _of(self, table: str, columns: str, terms: list[str]) -> DataFrame:
        rows = self.spark.read.schema(f"{columns}, bucket int").parquet(f"{self.root}/{table}")
        return rows.where(F.col("bucket").isin(*{bucket_of(t, self.buckets) for t in terms}) & F.col("term").isin(*set(terms))).drop("bucket")

    def postings(self, terms: list[str], id_kind: str = "string") -> DataFrame:
        """Rows of these terms; only their buckets are read."""
        return self._of("postings", f"id {id_kind}, term string", terms)

    def search(self, query: str | None, limit: int = 10, id_kind: str = "string") -> tuple[str, DataFrame]:
        """(status, rows): id, score, n_terms and matched, the best first.

        Rows score the idf of the query's terms that they have; a term that the query repeats counts as
        often. Ties: more terms, then the smaller id. Without a term in the query the status is
        NO_QUERY, without an indexed row NO_DATA, without a hit NO_MATCH, else OK."""
        none = self.spark.createDataFrame([], f"id {id_kind}, score double, n_terms long, matched array<string>")
        wanted = re.findall("[a-z0-9]+", (query or "").lower())
        if not (query or "").strip():
            return "NO_QUERY", none
        n = self.spark.read.parquet(f"{self.root}/size").first()["n"]
        if not n:
            return "NO_DATA", none
        if not wanted:
            return "NO_QUERY", none
        times = {t: wanted.count(t) for t in wanted}
        known = {r["term"]: r["df"] for r in self._of("terms", "term string, df long", list(times)).collect()}  # the query's terms at most
        if not known:
            return "NO_MATCH", none
        weights = self.spark.createDataFrame([(t, times[t]) for t in known], "term string, times long")
        counts = self.spark.createDataFrame(list(known.items()), "term string, df long").withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)
        hits = self.postings(list(known), id_kind).join(F.broadcast(weights.join(counts, "term")), "term")
        scored = hits.groupBy("id").agg(F.sum(F.col("idf") * F.col("times")).alias("score"), F.sum("times").alias("n_terms"), F.array_sort(F.collect_set("term")).alias("matched"))
        return "OK", scored.orderBy(F.desc("score"), F.desc("n_terms"), "id").limit(limit).withColumn("score", F.round("score", 4))


@dataclass
class PagedOrder:
    """Rows kept in order, in ranges whose sizes are known, so that any page reads the ranges it lies in."""

    spark: SparkSession
    root: str

    def build(self, rows: DataFrame, order: list[tuple[str, bool]], per_range: int = 100_000) -> PagedOrder:
        """Keep `rows` in `order`, (column, descending) with nulls last; it must tell all rows apart for
        pages to be stable. Ranges have `per_range` rows, the last one of a file perhaps fewer.

        A file holds about RANGES_OF_FILE ranges, one after the other, each in Parquet pages of its own;
        so there are as many times fewer tasks, files and rows sampled for bounds than ranges."""
        keys = self._keys(order)
        n = max(1, -(-rows.count() // (per_range * RANGES_OF_FILE)))
        ranged = rows.repartitionByRange(n, *keys).withColumn("_file", F.spark_partition_id()).sortWithinPartitions("_file", *keys)
        ranged = ranged.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))  # from 0 in each task
        ranged.write.mode("overwrite").option("parquet.page.row.count.limit", per_range).partitionBy("_file").parquet(f"{self.root}/rows")
        self.order, self.schema, self.per_range = order, ranged.schema, per_range
        files = self._kept().groupBy("_file").agg(F.count(F.lit(1)).alias("n")).orderBy("_file").collect()  # one row a file
        self.sizes = [((r["_file"], i), min(per_range, r["n"] - i * per_range)) for r in files for i in range(-(-r["n"] // per_range))]
        return self

    @staticmethod
    def _keys(order: list[tuple[str, bool]]) -> list[Column]:
        return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]

    def _kept(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/rows")

    @property
    def total(self) -> int:
        return sum(n for _, n in self.sizes)

    def ranges(self, offset: int, limit: int) -> tuple[list[tuple[int, int]], int]:
        """(ranges that rows offset .. offset + limit lie in, rows before the first of them)."""
        found, before, first = [], 0, 0
        for name, n in self.sizes:
            if before < offset + limit and before + n > offset:
                first = first if found else before
                found.append(name)
            before += n
        return found, first

    def within(self, names: list[tuple[int, int]]) -> DataFrame:
        """The rows of these ranges, with their file and their place in it."""
        inside = F.lit(False)
        for file in {f for f, _ in names}:
            own = [i for f, i in names if f == file]  # next to each other
            inside = inside | ((F.col("_file") == file) & F.col("_place").between(min(own) * self.per_range, (max(own) + 1) * self.per_range - 1))
        return self._kept().where(inside)

    def page(self, offset: int, limit: int = 50) -> DataFrame:
        """Rows offset .. offset + limit in order; past the end there are none."""
        names, first = self.ranges(offset, max(1, min(limit, 1000)))
        rows = self.within(names).orderBy("_file", "_place")
        return rows.offset(offset - first if names else 0).limit(max(1, min(limit, 1000))).drop("_file", "_place")

    def after(self, last: dict, limit: int = 50) -> DataFrame:
        """The page that follows the row `last` (its columns of the order, none of them null)."""
        beyond, equal = F.lit(False), F.lit(True)
        for c, down in self.order:
            here = F.col(c) < F.lit(last[c]) if down else F.col(c) > F.lit(last[c])
            beyond, equal = beyond | (equal & (here | F.col(c).isNull())), equal & (F.col(c) == F.lit(last[c]))
        return self._kept().drop("_file", "_place").where(beyond).orderBy(*self._keys(self.order)).limit(max(1, min(limit, 1000)))
