"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents are tokenised on the executors and cut into pieces of `max_tokens`. Full pieces are
sequences of their own. The others are dealt at random into groups of about `GROUP_TOKENS` tokens, and
each group is packed alone: best fit by decreasing length gives a start, then pieces of the emptiest
bin are moved, exchanged one for one or two for one with pieces of other underfull bins, each step
raising the sum of squared fills, until bins run empty. A group holds about 512 sequences however short
its pieces are, and wastes half a sequence on average, so groups cost about a thousandth of all.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

MAX_TOKENS = 2048
END_ID = 0
#: Tokens of a group at about, and pieces of one at most (these are single tokens then).
GROUP_TOKENS, GROUP_PIECES = 1 << 20, 1 << 20
#: Parts of words whose ids a worker remembers; beyond it only those stay that its present texts repeat often.
REMEMBERED, OFTEN = 600_000, 4
#: Bytes of text of which the words are told apart at once.
SLICE_BYTES = 16 << 20

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Latin letters that normalisation leaves as they are but for lower-casing, each a letter still then.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A plain word: letters, then perhaps signs, which the tokenizer takes as a run of their own.
_PLAIN = rf"^[{_LETTERS}]+[.,;:!?*$%&#]*$"
_STEM = rf"^[{_LETTERS}]+"


class WordTokens:
    """Token ids of words.

    The tokenizer drops white space and never joins text across it, so that a text's ids are those
    of its words in turn. A plain word's letters and signs are two parts; its letters, lower-cased,
    go straight to the tokenizer's model, as nothing else would be done to them. Other parts, which
    have a space in front here, take the tokenizer's whole way. Each part has a number; its ids lie at
    `ids[start[number] :][: size[number]]`."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {c: spell(chr(c))[0][0] for c in range(0xDF, 0x100)}  # as the model has them
        self._forget()

    def _forget(self) -> None:
        """Know nothing but part 0, which stands for the end of a text, and the empty part."""
        self.known = {"": 1}
        self.ids, self.size = np.array([END_ID], dtype="<u4"), np.array([1, 0])
        self.start = np.array([0, 1])

    def numbers(self, words: pa.Array, times: np.ndarray) -> np.ndarray:
        """Numbers of the two parts of distinct words, each of which the texts at hand have so often."""
        plain = pc.match_substring_regex(words, _PLAIN)
        low = pc.utf8_lower(words)
        signs = pc.dictionary_encode(pc.if_else(plain, pc.replace_substring_regex(low, _STEM, " "), ""))
        stems = pc.dictionary_encode(pc.if_else(plain, pc.utf8_rtrim(low, ".,;:!?*$%&#"), pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type))))
        at = stems.indices.to_numpy()
        keys = [*stems.dictionary.to_pylist(), *("" if s == " " else s for s in signs.dictionary.to_pylist())]
        often = np.bincount(at, times, len(keys)) >= OFTEN
        found = self._found(keys, often)
        return np.stack((found[at], found[len(stems.dictionary) + signs.indices.to_numpy()]), axis=1)

    def _found(self, keys: list[str], often: np.ndarray) -> np.ndarray:
        got = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(got < 0)
        if len(self.known) + len(new) > REMEMBERED and len(self.known) > 1:
            kept = np.flatnonzero((got > 1) & often)
            ids, size = self.gather(got[kept]), self.size[got[kept]]
            self._forget()
            self._add([keys[i] for i in kept.tolist()], ids, size)
            got = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
            new = np.flatnonzero(got < 0)
        if len(new):
            names = list(dict.fromkeys([keys[i] for i in new.tolist()]))
            self._add(names, *self.encode(names))
            got[new] = [self.known[keys[i]] for i in new.tolist()]
        return got

    def _add(self, keys: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.size), len(self.size) + len(keys)), strict=True))
        self.ids, self.size = np.concatenate((self.ids, ids)), np.concatenate((self.size, size))
        self.start = np.cumsum(self.size) - self.size

    def encode(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and the number of ids of each."""
        whole = [k[1:] for k in keys if k[0] == " "]
        found = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False))
        ids = [next(found).ids if k[0] == " " else [t.id for t in self.model.tokenize(k if k.isascii() else k.translate(self.spelled))] for k in keys]
        return np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids))

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words in turn."""
        size = self.size[numbers]
        shift = self.start[numbers] - (np.cumsum(size) - size)
        return self.ids[np.repeat(shift, size) + np.arange(int(size.sum()))]


_tokens: dict[str, WordTokens] = {}


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with END_ID behind it, and where each text starts in them (one
    more entry than texts). A null text counts as empty."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    seen = _tokens[path]
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = words.offsets.to_numpy()
    flat = pc.dictionary_encode(words.values.slice(bounds[0], bounds[-1] - bounds[0]))
    index = flat.indices.to_numpy()
    number = seen.numbers(flat.dictionary, np.bincount(index, minlength=len(flat.dictionary)))
    bounds = bounds[1:] - bounds[0]
    ids = [np.empty(0, "<u4")]
    with_ends = np.insert(number[index].ravel(), 2 * bounds, 0)
    ends = 2 * bounds + np.arange(1, len(bounds) + 1)  # behind each text's end
    for at in range(0, len(with_ends), 1 << 20):
        ids.append(seen.gather(with_ends[at : at + (1 << 20)]))
    total = np.concatenate(([0], np.cumsum(seen.size[with_ends])))
    return np.concatenate(ids), np.concatenate(([0], total[ends]))


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; null and empty texts are the end id alone."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1), SLICE_BYTES):
                ids, starts = token_ids(texts, tokenizer_path)
                size = np.diff(starts)
                parts = -(-size // max_tokens)
                row = np.repeat(np.arange(len(size)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                at = piece * max_tokens
                length = np.minimum(size[row] - at, max_tokens)
                begin = (starts[row] + at) * 4
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                arrays = [batch.column(0).take(pa.array(row + first)), *(pa.array(x, f.type) for x, f in zip((piece, at, length, crc), list(PIECES)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, schema=PIECES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        job, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each piece: longest pieces first, each into the fullest bin that still takes it."""
    out = np.empty(len(lengths), dtype=np.int64)
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    open_sizes, n = 0, 0  # bit f: some bin has f tokens free
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = open_sizes >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                open_sizes &= ~(1 << free)
        else:
            free, b, n = size, n, n + 1
        out[i] = b
        by_free[free - need].append(b)
        open_sizes |= 1 << (free - need)
    return out


def _pairs(own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One pair of pieces for each sum that two of `own` have, by growing sum. A bin has few different
    lengths, so few pairs."""
    first = own[np.unique(lengths[own], return_index=True)[1]]
    i, j = np.triu_indices(len(first), 1)
    order = own[np.argsort(lengths[own], kind="stable")]
    twin = np.flatnonzero(np.diff(lengths[order]) == 0)
    pairs = np.concatenate((np.stack((first[i], first[j]), axis=1), np.stack((order[twin], order[twin + 1]), axis=1)))
    return pairs[np.unique(lengths[pairs].sum(axis=1), return_index=True)[1]]


def _best_exchange(y: np.ndarray, room: np.ndarray, offers: np.ndarray, lengths: np.ndarray) -> tuple[int, np.ndarray, int]:
    """(gain, pieces that go in, place in y of the one that comes back) of the exchange that fills
    another bin most; offers are rows of pieces by growing sum. Gain 0: there is none."""
    if not len(offers):
        return 0, np.empty(0, np.int64), 0
    sums = lengths[offers].sum(axis=1)
    k = np.searchsorted(sums, room, side="right") - 1
    gain = np.where(k >= 0, sums[k] - y, 0)
    at = int(np.argmax(gain))
    return max(int(gain[at]), 0), offers[k[at]], at


def local_search(lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """Empty underfull bins by moves, one-for-one and two-for-one exchanges, until none can go.

    The emptiest bin gives first: each step puts more tokens into another bin than it takes from it.
    If no bin can be emptied so, fuller bins are filled up by exchanges with less full ones, which
    gathers the free space in few bins, and these are tried once more. Every step raises the sum of
    squared fills, so the search ends. A bin that cannot be emptied is left as it is."""
    bins = _emptied(lengths, bins.copy(), size)
    while len(np.unique(bins)) > -(-int(lengths.sum()) // size):
        closer = _emptied(lengths, _filled_up(lengths, bins.copy(), size), size)
        if len(np.unique(closer)) == len(np.unique(bins)):
            break
        bins = closer
    return bins


def _filled_up(lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """From the fullest bin down, each underfull bin takes what fills it most from less full bins: a
    piece more, or one or two pieces for one of its own."""
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    for to in np.argsort(-fill, kind="stable").tolist():
        while 0 < fill[to] < size:
            less = np.flatnonzero((fill[bins] < fill[to]) | ((fill[bins] == fill[to]) & (bins > to)))
            own = np.flatnonzero(bins == to)
            if not len(less):
                break
            offers = less[np.unique(lengths[less], return_index=True)[1]]
            spare = size - fill[to]
            # A piece that stays away and comes for nothing is an exchange for a piece of length 0.
            gain, new, at = _best_exchange(np.append(lengths[own], 0), np.append(lengths[own], 0) + spare, offers[:, None], lengths)
            if gain < spare:
                pair = _pairs_of_one_bin(less, bins, lengths)
                more = _best_exchange(np.append(lengths[own], 0), np.append(lengths[own], 0) + spare, pair, lengths)
                gain, new, at = max((gain, new, at), more, key=lambda e: e[0])
            if not gain:
                break
            giver = bins[new[0]]
            bins[new] = to
            if at < len(own):
                bins[own[at]] = giver
            fill[to] += gain
            fill[giver] -= gain
    return bins


def _pairs_of_one_bin(pieces: np.ndarray, bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Neighbouring pieces of the same bin, one pair for each sum, by growing sum."""
    order = pieces[np.lexsort((lengths[pieces], bins[pieces]))]
    same = np.flatnonzero(np.diff(bins[order]) == 0)
    pairs = np.stack((order[same], order[same + 1]), axis=1)
    return pairs[np.unique(lengths[pairs].sum(axis=1), return_index=True)[1]]


def _emptied(lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """Bins emptied from the emptiest on, each with all its pieces put into others or left as it was."""
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // size)
    stuck = np.zeros(len(fill), dtype=bool)
    while (fill > 0).sum() > least:
        candidates = np.flatnonzero((fill > 0) & ~stuck)
        if not len(candidates):
            break
        giver = candidates[np.argmin(fill[candidates])]
        before = bins.copy(), fill.copy()
        while fill[giver]:
            others = np.flatnonzero((fill > 0) & (fill < size))
            others = others[others != giver]
            if not len(others):
                break
            own = np.flatnonzero(bins == giver)
            free = size - fill
            # move: a piece into the bin that it fills best
            room = free[others]
            x = lengths[own]
            fits = np.where(room[None, :] >= x[:, None], x[:, None], 0)
            if fits.max(initial=0):
                a, b = np.unravel_index(np.argmax(fits), fits.shape)
                fill[giver] -= x[a]
                fill[others[b]] += x[a]
                bins[own[a]] = others[b]
                continue
            inside = np.flatnonzero(np.isin(bins, others))
            y, room = lengths[inside], (lengths + free[bins])[inside]  # what goes, what may come instead
            best = _best_exchange(y, room, own[np.argsort(x, kind="stable")][:, None], lengths)
            best = max(best, _best_exchange(y, room, _pairs(own, lengths), lengths), key=lambda e: e[0])
            gained, out, at = best
            if not gained:
                break
            back = inside[at]
            to = bins[back]
            bins[out] = to
            bins[back] = giver
            fill[to] += gained
            fill[giver] -= gained
        if fill[giver]:
            bins, fill = before
            stuck[giver] = True
        else:
            stuck[:] = False
    return bins


def pack_group(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    lengths = pdf["length"].to_numpy()
    bins = local_search(lengths, best_fit(lengths, size), size)
    order = np.argsort(bins, kind="stable")
    sorted_lengths, sorted_bins = lengths[order], bins[order]
    ends = np.cumsum(sorted_lengths)
    first = np.flatnonzero(np.diff(sorted_bins, prepend=-1))
    base = np.repeat(ends[first] - sorted_lengths[first], np.diff(np.append(first, len(order))))
    offset = np.empty(len(order), dtype=np.int64)
    offset[order] = ends - sorted_lengths - base
    return pdf.assign(sequence_id=(pdf["_group"].to_numpy() << 24) + bins, offset=offset).drop(columns="_group")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give one piece with the end id alone. Only documents of more than
    `max_tokens` ids are cut. Rows with a null id keep it; repeated rows are packed as often as they
    come. Texts of any length are cut, never shortened. Pieces of equal length are alike: which of them
    goes where is open, the number of sequences is not affected. An empty table gives no rows; other
    columns are ignored. Sequence ids are not dense."""
    cut = materialise(pieces(docs, tokenizer_path, id_col, text_col, max_tokens), "pieces")
    full = cut.where(F.col("length") == max_tokens).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < max_tokens)
    count, tokens = rest.agg(F.count(F.lit(1)), F.sum("length")).first()
    groups = max(1, -(-(tokens or 0) // GROUP_TOKENS), -(-count // GROUP_PIECES))
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.groupBy("_group").applyInPandas(lambda pdf: pack_group(pdf, max_tokens), schema)
    return full.unionByName(packed)
