"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into words at spaces; each distinct word of a batch is encoded once. All words of a
round lie in one flat array of symbols. A round looks up the rank of every adjacent pair, takes the
smallest rank of each word (a segmented minimum), merges the pairs of that rank from the left in all
words at once, compacts the array and goes on until no word has a pair left. A merge that makes a
pair of no greater rank is the word's last in its round, as that pair comes before those to the
right. Words are cut further where two neighbouring characters occur together in no piece, since no
merge can cross such a place. So a word of one letter takes a round for each doubling of its pieces,
and any word at most about one for each rank that it meets.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, ship

SPACE = "▁"
#: Distinct words that a worker remembers; beyond it forgets all and starts anew.
REMEMBERED = 400_000
NONE = np.int64(1) << 40

RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class PieceModel:
    """Pieces, scores and pair ranks of a SentencePiece BPE model file with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = np.zeros(256, dtype=np.int64)
        plain: dict[str, int] = {}
        self.spelled: list[bytes] = []
        self.is_byte = np.zeros(size, dtype=bool)
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.is_byte[i] = True
                self.spelled.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.spelled.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                plain[piece] = i
                self.spelled.append(piece.replace(SPACE, " ").encode())
        # Equal scores tie: the leftmost pair goes first, so equal scores share a rank.
        score = np.array([model.get_score(i) for i in range(size)])
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        self.by_char = np.full(0x110000, -1, dtype=np.int64)
        for piece, i in plain.items():
            if len(piece) == 1:
                self.by_char[ord(piece)] = i
        left, right, whole, joints = [], [], [], set()
        for piece, i in plain.items():
            for k in range(1, len(piece)):
                joints.add(piece[k - 1 : k + 1])
                a, b = plain.get(piece[:k]), plain.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(i)
        self.joints = np.array(sorted((ord(a) << 21) | ord(b) for a, b in joints), dtype=np.int64)
        keys = np.array(left, dtype=np.int64) * size + np.array(right, dtype=np.int64)
        self.size = size
        self._index(keys, np.array(whole, dtype=np.int64), rank)
        self.decimals = [str(i) for i in range(size)]

    def _index(self, keys: np.ndarray, whole: np.ndarray, rank: np.ndarray) -> None:
        """Hash table of pairs: buckets of four, under the first odd multiplier that fills none."""
        self.bits, rng = 18, np.random.default_rng(1)
        while True:
            for _ in range(20):
                self.factor = rng.integers(1 << 60, 1 << 63, dtype=np.uint64) | np.uint64(1)
                bucket = self._bucket(keys)
                order = np.argsort(bucket, kind="stable")
                starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                slot = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
                if slot.max(initial=0) < 4:
                    self.key = np.full((4, 1 << self.bits), -1, dtype=np.int64)
                    self.key[slot, bucket[order]] = keys[order]
                    self.merged = np.zeros((4, 1 << self.bits), dtype=np.int32)
                    self.merged[slot, bucket[order]] = whole[order]
                    self.ranks = rank
                    return
            self.bits += 1

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.factor) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, sym: np.ndarray) -> np.ndarray:
        """What each symbol makes with the next one; -1 for nothing."""
        key = sym[:-1] * self.size + sym[1:]
        bucket = self._bucket(key)
        out = np.full(len(sym), -1, dtype=np.int64)
        for way in range(4):
            hit = np.flatnonzero(self.key[way][bucket] == key)
            out[hit] = self.merged[way][bucket[hit]]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word starts in them (one more entry than words)."""
        cps = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        joint = (cps[:-1] << 21) | cps[1:]
        k = np.minimum(np.searchsorted(self.joints, joint), len(self.joints) - 1)
        cut = np.ones(len(cps), dtype=bool)
        cut[1:] = (self.joints[k] != joint) | (owner[1:] != owner[:-1])
        sym, seg = self.by_char[cps], np.cumsum(cut) - 1
        owner = owner[cut]  # the word of each part
        unknown = np.flatnonzero(sym < 0)
        if len(unknown):  # characters without a piece are spelled as bytes
            spelled = [self.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))] for c in cps[unknown].tolist()]
            width = np.ones(len(sym), dtype=np.int64)
            width[unknown] = [len(b) for b in spelled]
            fill = np.repeat(sym < 0, width)
            sym, seg = np.repeat(sym, width), np.repeat(seg, width)
            sym[fill] = np.concatenate(spelled)
        done_at, done_id = self._merge(sym, seg)
        order = np.argsort(done_at, kind="stable")
        word_of = owner[seg[done_at[order]]] if len(sym) else np.empty(0, np.int64)
        return done_id[order], np.searchsorted(word_of, np.arange(len(words) + 1))

    def _merge(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair remains; (first place, id) of the symbols that remain."""
        at = np.arange(len(sym))
        places, ids = [], []
        while len(sym):
            whole = self._pairs(sym)
            whole[:-1][seg[:-1] != seg[1:]] = -1
            rank = np.where(whole >= 0, self.ranks[whole], NONE)
            starts = np.flatnonzero(np.diff(seg, prepend=-1))
            lengths = np.diff(np.append(starts, len(seg)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < NONE, lengths)
            if not live.all():  # parts without a pair are done and leave the array
                places.append(at[~live]), ids.append(sym[~live])
                sym, seg, at, rank, whole = sym[live], seg[live], at[live], rank[live], whole[live]
                if not len(sym):
                    break
                lengths = lengths[best < NONE]
                best = best[best < NONE]
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            chosen = self._chosen(np.flatnonzero(rank == np.repeat(best, lengths)), sym, seg, whole)
            sym = sym.copy()
            sym[chosen] = whole[chosen]
            keep = np.ones(len(sym), dtype=bool)
            keep[chosen + 1] = False
            sym, seg, at = sym[keep], seg[keep], at[keep]
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(places), np.concatenate(ids)

    def _chosen(self, minimal: np.ndarray, sym: np.ndarray, seg: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Which of the least pairs are merged in one round, as if one after the other from the left:
        of overlapping ones every other one, and in each part all up to the first whose merge makes
        a pair of no greater rank with a neighbour."""
        run = np.flatnonzero(np.diff(minimal, prepend=-2) != 1)
        nth = np.arange(len(minimal)) - np.repeat(run, np.diff(np.append(run, len(minimal))))
        at = minimal[nth % 2 == 0]
        part, made = seg[at], whole[at]
        # What stands beside the merged pair then: to the left perhaps the pair that was merged before.
        before = np.maximum(at - 1, 0)
        follows = np.zeros(len(at), dtype=bool)
        follows[1:] = (at[1:] - at[:-1] == 2) & (part[1:] == part[:-1])
        left = np.where(follows, np.roll(made, 1), sym[before])
        after = np.minimum(at + 2, len(sym) - 1)
        rank = self.ranks[made]
        first, last = (at == 0) | (seg[before] != part), (at + 2 >= len(sym)) | (seg[after] != part)
        stop = ~first & (self._rank_of(left, made) <= rank)
        stop |= ~last & (self._rank_of(made, sym[after]) <= rank)
        stops = np.cumsum(stop) - stop  # before each pair
        new = np.flatnonzero(np.diff(part, prepend=-1) != 0)
        return at[stops == np.repeat(stops[new], np.diff(np.append(new, len(at))))]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what two symbols make together, NONE for nothing."""
        key = left * self.size + right
        bucket = self._bucket(key)
        out = np.full(len(key), NONE)
        for way in range(4):
            hit = np.flatnonzero(self.key[way][bucket] == key)
            out[hit] = self.ranks[self.merged[way][bucket[hit]]]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: one leading space, which encoding has put there, goes; bytes that are no
        UTF-8 become U+FFFD, one for each."""
        raw = b"".join([self.spelled[i] for i in ids])
        return _utf8(raw[1:] if raw[:1] == b" " else raw)


def _utf8(raw: bytes) -> str:
    return raw.decode("utf-8", "tallyspark_each_byte")


codecs.register_error("tallyspark_each_byte", lambda at: ("�", at.start + 1))


class _Words:
    """The words that a worker has seen, with their ids in decimals."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.decimals: dict[str, str] = {}
        self.spelled = {str(i): piece for i, piece in enumerate(model.spelled)}

    def learn(self, texts: list[list[str]]) -> None:
        words = set().union(*texts)
        new = words.difference(self.decimals)
        if len(self.decimals) + len(new) > REMEMBERED:
            self.decimals, new = {}, words
        if new:
            words = list(new)
            ids, starts = self.model.encode_words(words)
            decimals, starts = list(map(self.model.decimals.__getitem__, ids.tolist())), starts.tolist()
            for w, a, b in zip(words, starts, starts[1:], strict=False):
                self.decimals[w] = ",".join(decimals[a:b])


def split_words(text: str) -> list[str]:
    """The text as the library normalises it - a space in front, spaces as U+2581 - cut before each
    U+2581 that follows something else, so that runs of spaces stay with the word behind them."""
    if not text:
        return []
    return _WORD.findall(SPACE + text.replace(" ", SPACE))


_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
_models: dict[str, PieceModel] = {}
_seen: dict[str, _Words] = {}


def model_at(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(text: str | None, path: str) -> list[int]:
    """Ids of one text; the general form of what the jobs do by batch."""
    return model_at(path).encode_words(split_words(text or ""))[0].tolist()


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 (see the digests' rules in
    `digest_batches`). Null and empty texts have no tokens. Texts are encoded whole, however long they
    or their words are. Pairs of equal rank tie, and the leftmost goes first. A row with a null id
    keeps its null, repeated rows come out repeatedly, an empty table gives no rows, other columns
    are ignored."""

    ship(docs.sparkSession)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from digest_batches(batches, model_path)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        job, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def digest_batches(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the decimal ids joined by commas, and of the decoded text in UTF-8."""
    if model_path not in _seen:
        _seen[model_path] = _Words(model_at(model_path))
    seen = _seen[model_path]
    for batch in batches:
        tokens, of_ids, of_text = [], [], []
        for _, texts in chunks(batch.column(1)):
            split = [split_words(t) for t in texts]
            seen.learn(split)
            for words in split:
                ids = ",".join(map(seen.decimals.__getitem__, words))
                of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                pieces = ids.split(",") if ids else []
                tokens.append(len(pieces))
                raw = b"".join(map(seen.spelled.__getitem__, pieces))[1:]  # the first id starts with the added space
                of_text.append(hashlib.sha256(_utf8(raw).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], schema=RESULT)
