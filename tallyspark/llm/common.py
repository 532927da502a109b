"""What the operators of this subpackage share: reading, stage tables, text chunks, word hashes."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; a single longer text is a step of its own.
CHUNK_BYTES = 1 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tallyspark-")) / "tallyspark_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none and
    all runs on one machine, as in tests, a folder of this machine is set; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tallyspark-stages-')}"
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
    return at


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write `df` as a stage table in the shared folder and read it back: lineage ends at files that
    outlive any executor. Tables that a lazy result still needs stay until `clear`; operators
    discard the others themselves."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/stage-{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    gc.collect()  # plans that nothing refers to any more let Spark drop their shuffle files
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.stage_path = path
    return out


_written: dict[str, set[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, df.stage_path)


def written(spark: SparkSession) -> set[str]:
    """Paths of the stage tables that this application has written and not deleted."""
    return set(_written.get(spark.sparkContext.applicationId, ()))


def forget(spark: SparkSession, keep: set[str]) -> None:
    """Delete the stage tables of this application but those to keep."""
    for path in written(spark) - keep:
        _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all stage tables of this application, once its results are written."""
    for path in list(_written.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


#: A key with more than this share of all rows is hot; there are as many hot keys at most.
HOT_SHARE = 1024


def join_by_key(rows: DataFrame, keyed: DataFrame, key: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of `rows` with `keyed`, which has one row for each key and in `weight` at least the
    number of the key's rows; the weights sum up to `total` at most, or nearly so.

    Hot keys, HOT_SHARE or so at most, are broadcast, so that their rows stay where they are; all
    others are shuffled. Weights decide only the way, never the result."""
    least = max(1, total // HOT_SHARE)
    hot = F.broadcast(keyed.where(F.col(weight) > least))
    rest = rows.join(hot.select(*key), key, "left_anti").join(keyed.where(F.col(weight) <= least), key)
    return rows.join(hot, key).unionByName(rest)


#: Words of 64 bits that a sieve has at most.
SIEVE = 1 << 19


def sieved(rows: DataFrame, column: str, wanted: DataFrame, among: str) -> DataFrame:
    """Those of the rows whose `column` may stand in column `among` of `wanted`, which is read twice and
    counts repeated values each time; both are of one type. A join with `wanted` that follows shuffles few rows besides its own.

    A broadcast table has a bit or more for each value, eight if there are not more than SIEVE words; rows of
    a null go. What the sieve lets through decides only the way, never the result."""
    words = 1 << min(SIEVE.bit_length() - 1, (wanted.count() // 8).bit_length())
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(words * 64))
    word, bit = F.expr("shiftright(_spot, 6)").alias("_word"), F.expr("shiftleft(1L, CAST(_spot & 63 AS INT))")
    bits = wanted.where(F.col(among).isNotNull()).select(spot(among).alias("_spot")).groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    found = rows.where(F.col(column).isNotNull()).withColumn("_spot", spot(column)).withColumn("_word", F.expr("shiftright(_spot, 6)")).join(F.broadcast(bits), "_word")
    return found.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def remainder(key: str, by: int) -> Column:
    """crc32 of the id written as decimal text, modulo `by`; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % by


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for runs of rows with about `size` bytes of text; a null text counts as empty."""
    for at, part in slices(texts, size):
        yield at, [t or "" for t in part.to_pylist()]


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) for runs of rows with about `size` bytes of text, as Arrow arrays."""
    texts = texts if pa.types.is_large_string(texts.type) else texts.cast(pa.large_string())
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(lengths), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, total[at] - lengths[at] + size, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


_RNG = np.random.default_rng(0x7A11)
_BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 4096), _BASE if which == "up" else _BASE_INVERSE, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 8 * CHUNK_BYTES:  # a longer one serves one giant text and goes
            _powers[which] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every bit depends on every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(texts: list[str], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts, joined by a line feed, as UTF-8.

    Returns the bytes, the words' starts and ends in them, and for each text the number of its first
    word (one more entry than texts). `lower` lower-cases A-Z only."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(parts) + b"\n"
    raw = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
    gap = _SPACE[raw]
    edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return raw, starts, ends, first


def word_hashes(texts: list[str], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and for each text the number of its first word."""
    raw, starts, ends, first = word_spans(texts, lower)
    if not len(starts):
        return np.empty(0, np.uint64), first
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_CODES[raw] * _power("up", len(raw)), dtype=np.uint64)))
    h = (total[ends] - total[starts]) * _power("down", len(raw))[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), first


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, given the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[i : i + n]
    return mix(out ^ np.uint64(k))
