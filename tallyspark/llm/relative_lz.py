"""Substring deduplication by relative Lempel-Ziv parsing against distributed reference blocks.

A window is `WINDOW` consecutive words. Of the `SEED`-word runs in a window the one with the least
hash is its anchor, so equal windows have equal anchors wherever they are. Anchors that occur twice
or more among the distinct texts index the corpus: each occurrence, with as many words on either
side as a window can reach, is a phrase of the reference block that its anchor hashes to. So each
text is parsed against just those blocks that hold anything of it.

In its block every phrase is parsed greedily against all other phrases of its anchor: the parse goes
to the first word from which another phrase has the words up to the anchor, and takes the longest
factor from there that any of them has. A factor of `WINDOW` words or more is a repeated span.
Windows that start inside a factor and cross its end are looked up by their hash, and only these.
An anchor with very many occurrences is dealt to several blocks; then each block hands on one entry
for each distinct window, and a last grouping finds the windows that repeat only across those
blocks. No task gets more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, join_by_key, materialise, mix, runs, word_hashes, word_spans

WINDOW, SEED = 35, 16
#: Words beside an anchor that a window around it can reach, and the words of a phrase.
REACH = WINDOW - SEED
PHRASE = SEED + 2 * REACH
#: Phrases of a block, and occurrences of one anchor in one block.
BLOCK_PHRASES, BLOCK_COPIES = 20_000, 1024

_BASE = np.uint64(0xB492B66FBE98F273)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows that lie in one text. `words`: the hashes of
    the texts' words one after the other, `first`: where each text starts."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    seeds = runs(words, SEED)
    least = _slide(seeds, REACH + 1, np.minimum)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    least[text[: len(least)] != text[WINDOW - 1 :]] = 0
    edge = np.zeros(REACH, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((edge, least, edge)), REACH + 1, np.maximum) == seeds)
    return at, seeds[at]


def _key(text: Column) -> Column:
    """128 bits that name a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in chunks(batch.column(2)):
            words, first = word_hashes(texts, lower=False)
            place, seed = anchors(words, first)
            text = np.searchsorted(first, place, side="right") - 1
            ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (seed.view(np.int64), (place - first[text]).astype(np.int32)))
            rows = (batch.column(i).slice(at, len(texts)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*rows, pa.array(np.diff(first)), *lists], names=["id", "key", "n_words", "seeds", "places"])


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_no, text, hits) to one row for each hit, with the phrase as 32-bit word hashes."""
    columns = np.arange(PHRASE) - REACH
    for batch in batches:
        for at, texts in chunks(batch.column(1)):
            words, first = word_hashes(texts, lower=False)
            short = np.concatenate((words >> np.uint64(32), np.zeros(1, np.uint64))).astype("<u4")
            hits = batch.column(2).slice(at, len(texts))
            flat = hits.flatten()
            row = np.repeat(np.arange(len(texts)), np.asarray(hits.value_lengths()))
            seed, copies, place = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            size = np.diff(first)[row]
            for a in range(0, len(row), 8192):
                part = slice(a, a + 8192)
                where = place[part, None] + columns
                where = np.where((where >= 0) & (where < size[part, None]), where + first[row[part], None], len(words))
                raw = short[where].tobytes()
                n = len(where)
                phrase = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * 4 * PHRASE), pa.py_buffer(raw)])
                left, right = np.minimum(place[part], REACH), np.minimum(size[part] - SEED - place[part], REACH)
                key = batch.column(0).take(pa.array(row[part] + at))
                arrays = [key, pa.array(place[part].astype(np.int32)), pa.array(seed[part]), pa.array(copies[part].astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), phrase]
                yield pa.RecordBatch.from_arrays(arrays, names=["text_no", "place", "seed", "copies", "left", "right", "phrase"])


def parse(words: np.ndarray, group: np.ndarray, left: np.ndarray, total: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each phrase's factor around the anchor: the first word from which some other
    phrase of the group has all words to the anchor's end, and the longest match from there. Words
    beyond a text's ends must differ from all others. Start -1: no other phrase has the anchor."""
    n, tail = len(words), REACH + SEED
    # By what follows the anchor: of phrases that are equal up to there, neighbours share most.
    follows = np.empty(n, dtype=np.int64)
    follows[np.lexsort(words[:, :tail - 1 : -1].T)] = np.arange(n)
    start, end = np.full(n, -1), np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    for first in range(REACH + 1):
        open_groups = np.zeros(int(group.max(initial=-1)) + 1, dtype=bool)
        open_groups[group[start < 0]] = True
        rows = rows[open_groups[group[rows]]]
        if not len(rows):
            break
        at = rows[left[rows] >= REACH - first]
        h = mix((total[at, tail] - total[at, first]) * back[first]) ^ mix(group[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        order = np.lexsort((follows[at], h))
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        a, b = at[order[same]], at[order[same + 1]]
        shared = np.cumprod(words[a, tail:] == words[b, tail:], axis=1).sum(axis=1)
        most = np.full(n, -1)
        np.maximum.at(most, a, shared)
        np.maximum.at(most, b, shared)
        found = np.flatnonzero((start < 0) & (most >= 0))
        start[found], end[found] = first, tail + most[found]
    return start, end


def factor_block(block: pa.Table, block_copies: int) -> pa.Table:
    """Spans (start, end) of repeated words, and open windows of anchors that other blocks have too."""
    n = len(block)
    seed, salt, copies, place, left, right = (block.column(c).to_numpy().astype(np.int64) for c in ("seed", "salt", "copies", "place", "left", "right"))
    words = np.frombuffer(b"".join(block.column("phrase").to_pylist()), "<u4").reshape(n, PHRASE).astype(np.uint64)
    at = np.arange(PHRASE)
    outside = (at < REACH - left[:, None]) | (at >= REACH + SEED + right[:, None])
    words[outside] = (np.uint64(1) << np.uint64(32)) + np.flatnonzero(outside).astype(np.uint64)
    order = np.lexsort((salt, seed))
    new = np.ones(n, dtype=bool)
    new[1:] = (np.diff(seed[order]) != 0) | (np.diff(salt[order]) != 0)
    group = np.empty(n, dtype=np.int64)
    group[order] = np.cumsum(new) - 1

    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(PHRASE - 1, _BASE))), dtype=np.uint64)
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(REACH, _BASE_INVERSE))), dtype=np.uint64)
    total = np.concatenate((np.zeros((n, 1), np.uint64), np.cumsum((words + np.uint64(1)) * power, axis=1, dtype=np.uint64)), axis=1)
    start, end = parse(words, group, left, total, back)
    long = end - start >= WINDOW
    low, high = np.where(long & (start >= 0), start, PHRASE), np.where(long & (start >= 0), end, 0)

    # Windows that cross a factor's end: no factor shows whether another phrase has them.
    column = np.arange(REACH + 1)
    valid = (column >= REACH - left[:, None]) & (column <= right[:, None])
    crossing = valid & (start >= 0)[:, None] & (column > start[:, None]) & (column + WINDOW > end[:, None])
    asked = np.zeros((int(group.max(initial=-1)) + 1, REACH + 1), dtype=bool)
    row, col = np.nonzero(crossing)
    asked[group[row], col] = True
    row, col = np.nonzero(valid & asked[group])

    def window(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return mix((total[row, col + WINDOW] - total[row, col]) * back[col])

    own = window(row, col) ^ mix((group[row] * (REACH + 1) + col).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    _, number, times = np.unique(own, return_inverse=True, return_counts=True)
    hit = crossing[row, col] & (times[number] > 1)
    row, col = row[hit], col[hit]
    np.minimum.at(low, row, col)
    np.maximum.at(high, row, col + WINDOW)  # all these windows hold the anchor, so their union has no gap

    base = place - REACH
    found = np.flatnonzero(high > 0)
    spans = {"text_no": block.column("text_no").take(pa.array(found)), "start": pa.array(base[found] + low[found]), "end": pa.array(base[found] + high[found])}
    spans |= {"window": pa.nulls(len(found), pa.int64()), "seed": pa.nulls(len(found), pa.int64()), "settled": pa.array(np.ones(len(found), dtype=bool))}
    # One entry for each distinct window of anchors that were dealt to several blocks.
    r, c = np.nonzero(valid & (copies > block_copies)[:, None])
    _, one = np.unique(np.stack((window(r, c), seed[r].astype(np.uint64)), axis=1), axis=0, return_index=True) if len(r) else (None, np.empty(0, np.int64))
    r, c = r[one], c[one]
    more = {"text_no": block.column("text_no").take(pa.array(r)), "start": pa.array(base[r] + c), "end": pa.array(base[r] + c + WINDOW)}
    more |= {"window": pa.array(window(r, c).view(np.int64)), "seed": pa.array(seed[r]), "settled": pa.array((low[r] <= c) & (c + WINDOW <= high[r]))}
    schema = pa.schema([("text_no", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("window", pa.int64()), ("seed", pa.int64()), ("settled", pa.bool_())])
    return pa.concat_tables([pa.table(x).cast(schema) for x in (spans, more)])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_phrases: int = BLOCK_PHRASES, block_copies: int = BLOCK_COPIES) -> DataFrame:
    """For each distinct text with a repeated window: key (MD5), copies (rows with that text) and
    spans, an array of (start, end) in words, end exclusive. A text that several rows have repeats
    as a whole, its spans are then of no further interest."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    index = rows.mapInArrow(_indexed, "id long, key binary, n_words long, seeds array<long>, places array<int>")
    index = materialise(index.withColumn("row", F.monotonically_increasing_id()), "anchors")
    # One row stands for each distinct text; its number names the text from here on.
    texts = index.groupBy("key").agg(F.min_by(F.struct("row", "id"), "row").alias("one"), F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"))
    texts = materialise(texts.select("key", F.col("one.row").alias("text_no"), F.col("one.id").alias("rep"), "copies", "n_words"), "texts")
    first = index.select("row", "seeds", "places").join(texts.select(F.col("text_no").alias("row")), "row", "left_semi")
    entries = first.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("e")).select(F.col("e.seeds").alias("seed"), F.col("row").alias("text_no"), F.col("e.places").alias("place"))
    seeds = materialise(entries.groupBy("seed").agg(F.count(F.lit(1)).cast("int").alias("copies")).where("copies > 1"), "seeds")
    total = seeds.agg(F.sum("copies")).first()[0] or 0
    hits = join_by_key(entries, seeds, ["seed"], "copies", total).groupBy("text_no").agg(F.collect_list(F.struct("seed", "copies", "place")).alias("hits"))
    hits = materialise(hits.join(texts.select("text_no", "key", "rep"), "text_no"), "hits")
    discard(index, seeds)

    named = (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("rep"))
    phrases = rows.join(hits.select(F.col("key").alias("_key"), "rep", "text_no", "hits"), named).select("text_no", "text", "hits")
    phrases = phrases.mapInArrow(_phrases, "text_no long, place int, seed long, copies int, left int, right int, phrase binary")
    phrases = phrases.withColumn("salt", F.pmod(F.xxhash64("text_no", "place"), F.ceil(F.col("copies") / block_copies)).cast("int"))
    block = F.pmod(F.xxhash64("seed", "salt"), F.lit(-(-total // block_phrases) or 1))
    factored = phrases.groupBy(block.alias("block")).applyInArrow(lambda t: factor_block(t, block_copies), "text_no long, start long, end long, window long, seed long, settled boolean")
    factored = materialise(factored, "factors")
    discard(hits)
    opened = factored.where("window IS NOT NULL")
    across = opened.groupBy("seed", "window").agg(F.min(F.struct("text_no", "start")).alias("low"), F.max(F.struct("text_no", "start")).alias("high"), F.bool_or("settled").alias("settled"))
    across = across.where("settled OR low != high").select("seed", "window")
    late = opened.where("NOT settled").join(across, ["seed", "window"])
    spans = factored.where("window IS NULL").select("text_no", "start", "end").unionByName(late.select("text_no", "start", "end"))
    spans = spans.groupBy("text_no").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    spans = spans.join(texts.select("text_no", "key"), "text_no").drop("text_no")
    copied = texts.where(f"copies > 1 AND n_words >= {WINDOW}").select("key", "copies")
    out = materialise(copied.join(spans, "key", "full").select("key", F.coalesce("copies", F.lit(1)).alias("copies"), "spans"), "spans")
    discard(texts, factored)
    return out


def _kept(with_text: bool):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                raw, starts, ends, first = word_spans(texts, lower=False)
                raw = raw.tobytes()
                copies, spans = (batch.column(i).slice(at, len(texts)).to_pylist() for i in (2, 3))
                total, removed, digests, left = [], [], [], []
                for i in range(len(texts)):
                    a, b = int(first[i]), int(first[i + 1])
                    keep = np.ones(b - a, dtype=bool)
                    if (copies[i] or 1) > 1 and b - a >= WINDOW:
                        keep[:] = False
                    for span in spans[i] or ():
                        keep[span["start"] : span["end"]] = False
                    chosen = np.flatnonzero(keep) + a
                    kept = b" ".join([raw[s:e] for s, e in zip(starts[chosen].tolist(), ends[chosen].tolist(), strict=True)])
                    total.append(b - a), removed.append(b - a - len(chosen)), digests.append(hashlib.sha256(kept).hexdigest())
                    left.append(kept.decode("utf-8", "replace") if with_text else None)
                arrays = [batch.column(0).slice(at, len(texts)), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return job


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, block_phrases: int = BLOCK_PHRASES, block_copies: int = BLOCK_COPIES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and kept_text if wanted.

    Every word covered by a window of 35 words that starts anywhere else as well goes, in all its
    places; the input decides, not what is left. Words are runs of anything but ASCII white space.
    Null, empty and blank texts have no words; texts of fewer words than a window lose none. Rows
    with a null or repeated id are rows like any other: an equal text elsewhere is a repetition. Long
    texts are read whole. Nothing is chosen among repetitions, so there are no ties. An empty table
    gives no rows; other columns are ignored."""
    spans = repeated_spans(docs, id_col, text_col, block_phrases, block_copies)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _key(F.col(text_col)).alias("key"))
    out = rows.join(spans, "key", "left").select("doc_id", "text", "copies", "spans")
    out = out.mapInArrow(_kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")
