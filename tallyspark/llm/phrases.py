"""Phrases by count tries of limited depth, merged level by level.

Every task cuts its texts into pieces and words and counts the phrases of one length by language: its
shard of that level of the trie, written in order. The shards are merged by ranges of the phrases'
words, so that a word with very many phrases spreads over tasks. A phrase is never more frequent than
its parts, so the next level counts only phrases whose two shorter parts are frequent; a bit table of
fixed size tells tasks which are, and lets through a few more, which the merge then drops. Walking
the merged trie in order gives each phrase its left parts; right parts are looked up by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_by_key, materialise, mix, slices, word_hashes

#: Bytes of text that one step counts, bits of the table of frequent phrases at most, and bits for each.
SHARD_BYTES, MOST_BITS, BITS_EACH = 8 << 20, 1 << 27, 16
#: Parts of a language that are ranked apart before its best rows meet.
PARTS = 64
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True


def words_of(depth: int) -> list[str]:
    return [f"w{i + 1}" for i in range(depth)]


def _cut(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, in order; code, piece and text of every word) of texts in lower case (A-Z)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(parts).lower() + b"\n", dtype=np.uint8)
    gap = _GAP[raw]
    edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~gap])]).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    piece = np.searchsorted(np.flatnonzero(_BREAK[raw]), starts)
    text = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, side="right")
    return words.dictionary.take(pa.array(order)), place[words.indices.to_numpy()], piece, text


def _mixed(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases, from those of their language and words."""
    out = lang.copy()
    for h in words:
        out = out * np.uint64(0x9FB21C651E98DF25) + h
    return mix(out)


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _hashes(words: list[str]) -> np.ndarray:
    return word_hashes(["\n".join(words)], lower=False)[0]


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    first, second = _places(h, len(table) * 64)
    bit = lambda at: (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
    return (bit(first) & bit(second)).astype(bool)


def _shards(depth: int, known):
    """key and n of the phrases of each run of texts, in order: a key is the words and the language with
    tabs between. `known` is None, or tells the bit table of the frequent phrases one word shorter."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value if known is not None else None
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, part in slices(batch.column("text"), SHARD_BYTES):
                own = langs[at : at + len(part)]
                names = sorted(set(own))
                number = {x: i for i, x in enumerate(names)}
                words, code, piece, text = _cut(part.to_pylist())
                lang = np.array([number[x] for x in own], dtype=np.int64)[text]
                n = len(code) - depth + 1
                if n <= 0:
                    continue
                held = piece[:n] == piece[depth - 1 :]  # a text's end is a piece's end
                if table is not None:
                    h, of_lang = _hashes(words.cast(pa.large_string()).to_pylist())[code], np.array([_lang_hash(x) for x in names], dtype=np.uint64)[lang]
                    m = len(code) - depth + 2
                    frequent = _passes(table, _mixed(of_lang[:m], [h[i : i + m] for i in range(depth - 1)]))
                    held &= frequent[:n] & frequent[1 : n + 1]
                at_ = np.flatnonzero(held)
                key, size = lang[at_], len(names)
                for i in range(depth):
                    if size * len(words) >= 1 << 63:
                        distinct, key = np.unique(key, return_inverse=True)
                        size = len(distinct)
                    key, size = key * len(words) + code[at_ + i], size * len(words)
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                first = at_[first]
                columns = [words.take(pa.array(code[first + i])) for i in range(depth)]
                key = pc.binary_join_element_wise(*columns, pa.array([x.encode() for x in names], pa.large_binary()).take(pa.array(lang[first])), pa.scalar(b"\t", pa.large_binary()))
                yield pa.record_batch([key.cast(pa.string()), pa.array(count, pa.int64())], names=["key", "n"])

    return job


def _bits(depth: int, bits: int):
    def job(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                codes, names = pd.factorize(pdf["lang"])
                h = _mixed(np.array([_lang_hash(x) for x in names], dtype=np.uint64)[codes], [_hashes(pdf[w].tolist()) for w in words_of(depth)])
                at = np.concatenate(_places(h, bits))
                out = pd.DataFrame({"slot": at >> 6, "bits": np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)})
                yield out.groupby("slot", as_index=False).agg(bits=("bits", np.bitwise_or.reduce))

    return job


def _bit_table(level: DataFrame, depth: int) -> np.ndarray:
    """The bits of a level's phrases; MOST_BITS at most, however many phrases there are."""
    bits = 1 << 10
    while bits < MOST_BITS and bits < BITS_EACH * level.count():
        bits *= 2
    rows = level.mapInPandas(_bits(depth, bits), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def _walk(depth: int):
    """The trie in order -> with the counts f1 .. of each row's first words, as far as the range's
    earlier rows have them (else 0)."""

    def job(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, have = TaskContext.get().partitionId(), 0, [0] * depth
        for pdf in parts:
            n = len(pdf)
            if not n:
                continue
            f, level = pdf["f"].to_numpy(), pdf["depth"].to_numpy()
            out = {"_part": np.full(n, part), "_at": np.arange(at, at + n)}
            for k in range(1, depth):
                last = np.maximum.accumulate(np.where(level == k, np.arange(n), -1))
                out[f"f{k}"] = np.where(last >= 0, f[last], have[k])
                have[k] = int(out[f"f{k}"][-1])
            at += n
            yield pdf.assign(**out)

    return job


def _with_left_parts(trie: DataFrame, depth: int) -> DataFrame:
    """The trie's rows with f1 .. f<depth-1>, the counts of their first 1 .. words."""
    order, parts = ["lang", *words_of(depth)], [f"f{k}" for k in range(1, depth)]
    dealt = trie.repartitionByRange(*order).sortWithinPartitions(*order)  # nulls first: a phrase precedes longer ones
    kinds = ", ".join(f"{c} {kind}" for c, kind in dealt.dtypes)
    walked = materialise(dealt.mapInPandas(_walk(depth), f"{kinds}, _part long, _at long, " + ", ".join(f"{c} long" for c in parts)), "trie")
    ends = walked.groupBy("_part").agg(*(F.max_by(c, "_at").alias(c) for c in parts)).orderBy("_part").collect()  # one row a range
    before, have = [], [0] * len(parts)
    for end in ends:
        before.append((end["_part"], *have))
        have = [end[c] or old for c, old in zip(parts, have, strict=True)]
    if not before:
        return walked.drop("_part", "_at")
    known = trie.sparkSession.createDataFrame(before, "_part long, " + ", ".join(f"_{c} long" for c in parts))
    out = walked.join(F.broadcast(known), "_part")
    return out.withColumns({c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.col(f"_{c}")) for c in parts}).drop("_part", "_at", *(f"_{c}" for c in parts))


def _phrase(first: int, last: int) -> Column:
    return F.concat_ws(" ", *(F.col(w) for w in words_of(last)[first:]))


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z) and split at `[.,;:!?\\x0A-\\x0D]` into pieces, and those into words at
    blanks and tabs; a null text is empty, a null language is `und`. a is a phrase's number of
    occurrences within pieces (`least` or more), n that of all words of its language. Cut after its
    first words, a phrase scores floor(1000000 * a * a / (l * r)) by the counts of both parts; the cut
    of the lowest score counts, of ties that with the shortest first part. A phrase goes if a longer
    one that holds its words contiguously has `share` percent or more of its occurrences. Ranks go by
    score, then a, both descending, then the phrase's UTF-8 bytes. Very long texts are counted whole,
    repeated rows count as often as they come, an empty table gives no rows, and other columns are
    ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    levels, known, sizes = [], None, None
    for depth in range(1, longest + 1):
        shards = materialise(rows.mapInArrow(_shards(depth, known), "key string, n long"), f"shards-{depth}")
        if depth == 1:
            lang = F.expr("substr(key, instr(key, '\t') + 1)")
            sizes = materialise(shards.groupBy(lang.alias("lang")).agg(F.sum("n").alias("n")), "sizes")
        merged = shards.repartitionByRange("key").groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        parts = F.split("key", "\t", depth + 1)
        levels.append(materialise(merged.select(F.get(parts, F.lit(depth)).alias("lang"), *(F.get(parts, F.lit(i)).alias(w) for i, w in enumerate(words_of(depth))), "f"), f"level-{depth}"))
        discard(shards)
        if known is not None:
            known.destroy()
        if depth < longest:
            known = spark.sparkContext.broadcast(_bit_table(levels[-1], depth))  # MOST_BITS bits at most

    trie = None
    for depth, level in enumerate(levels, 1):
        blank = [F.lit(None).cast("string").alias(w) for w in words_of(longest)[depth:]]
        level = level.select("lang", *words_of(depth), *blank, "f", F.lit(depth).alias("depth"))
        trie = level if trie is None else trie.unionByName(level)
    trie = _with_left_parts(trie, longest)
    discard(*levels)

    # Right parts. A part has at least `least` occurrences for each phrase that ends with it.
    found = trie.where("depth > 1").withColumn("phrase", _phrase(0, longest))
    cut = F.explode(F.filter(F.array(*(
        F.struct(F.lit(k).alias("k"), F.col(f"f{k}").alias("l"), _phrase(k, longest).alias("rest")) for k in range(1, longest)
    )), lambda x: x["k"] < F.col("depth")))
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), "depth", cut.alias("cut")).select("lang", "phrase", "a", "depth", "cut.*")
    ends = trie.where(F.col("depth") < longest).select("lang", _phrase(0, longest).alias("rest"), F.col("f").alias("r"), F.ceil(F.col("f") / least).alias("most"))
    total = ends.agg(F.sum("most")).first()[0] or 0
    cuts = join_by_key(cuts, ends, ["lang", "rest"], "most", total)
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumns({"_a": wide("a"), "_l": wide("l"), "_r": wide("r")}).withColumn("score", F.expr("(_a * _a * 1000000) div (_l * _r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = [(i, i + size, whole) for whole in range(3, longest + 1) for size in range(2, whole) for i in range(whole - size + 1)]
    within = F.array(*(F.struct(F.lit(whole).alias("whole"), _phrase(i, j).alias("part")) for i, j, whole in inner)) if inner else F.array().cast("array<struct<whole:int,part:string>>")
    held = found.where("depth > 2").select("lang", "f", F.explode(F.filter(within, lambda x: x["whole"] == F.col("depth"))).alias("x"))
    held = held.groupBy("lang", F.col("x.part").alias("phrase")).agg(F.max("f").alias("longer"))
    left = scored.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))

    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score")).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return left.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
