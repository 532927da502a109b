"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound by multiplying its letters'
vectors, each rotated by its place; a text or a language is the bundle (sum) of its trigrams'
vectors. Documents are compared with language prototypes by cosine. Prototypes are bundled on the
executors, one partial sum for each language and task, over all rows that may be learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, ship

DIMENSIONS = 1024
#: Letters a to z have ids of their own; others share the rest by code point. 0 is anything else.
LETTERS = 64
UNKNOWN = "und"
SEED = 0x1D6

_tables: dict[str, np.ndarray] = {}


def _letter_ids() -> np.ndarray:
    """Id of every code point, lower-cased."""
    if "ids" not in _tables:
        ids = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = ord(chr(c).lower()[0])
                ids[c] = low - 96 if 97 <= low <= 122 else 27 + low % (LETTERS - 27)
        _tables["ids"] = ids
    return _tables["ids"]


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of trigram codes."""
    if "letters" not in _tables:
        rng = np.random.default_rng(SEED)
        plain = rng.choice(np.array([-1, 1], dtype=np.int8), (LETTERS, DIMENSIONS))
        _tables["letters"] = np.stack([np.roll(plain, shift, axis=1) for shift in (2, 1, 0)])
    first, middle, last = _tables["letters"]
    return (first[codes >> 12] * middle[(codes >> 6) & 63] * last[codes & 63]).astype(np.float32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of all trigrams of letters and word edges, words being runs of letters."""
    ids = _letter_ids()[np.frombuffer("\n\n".join(texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", dtype=np.uint32)].astype(np.int64)
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    sizes[-1] -= 1
    text = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
    ids, text = ids[keep], text[keep]
    ids = np.concatenate(([0], ids))
    code, owner = (ids[:-2] << 12) | (ids[1:-1] << 6) | ids[2:], text[:-1]
    inside = ids[1:-1] != 0
    return owner[inside], code[inside]


def bundles(texts: list[str]) -> np.ndarray:
    """The sum of its trigrams' vectors for each text; zero for a text without letters."""
    text, code = trigrams(texts)
    present = np.flatnonzero(np.bincount(code, minlength=1 << 18))
    if not len(present):
        return np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    dense = np.zeros(1 << 18, dtype=np.int64)
    dense[present] = np.arange(len(present))
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    vectors = trigram_vectors(present)
    for at in range(0, len(texts), 256):
        n = min(256, len(texts) - at)
        own = (text >= at) & (text < at + n)
        counts = np.bincount((text[own] - at) * len(present) + dense[code[own]], minlength=n * len(present))
        out[at : at + n] = counts.reshape(n, -1).astype(np.float32) @ vectors
    return out


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the bundles by language, one row for each language of the task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for at, texts in chunks(batch.column(0)):
            own = bundles(texts)
            for lang in set(langs[at : at + len(texts)]):
                total = own[langs[at : at + len(texts)] == lang].sum(axis=0, dtype=np.float64)
                sums[lang] = sums.get(lang, 0) + total
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["lang", "bundle"])


def prototypes(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages in order of their names, and their unit prototypes: as many rows as languages."""
    sums = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(_partial, "lang string, bundle array<double>")
    total = sums.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    total = total.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("bundle"))
    found = {lang: np.array(bundle) for lang, bundle in total.collect() if any(bundle)}
    langs = sorted(found)
    return langs, np.array([found[lang] / np.linalg.norm(found[lang]) for lang in langs]).reshape(len(langs), DIMENSIONS)


def predict_language(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (cosine, not below 0).

    Learns from rows where `may_learn` holds and text and lang are not null. A null text, or one
    without a letter, gives `und` and 0, and so does everything if nothing can be learned. Ties go to
    the first language by name. Texts are read whole; rows of a null or repeated id are rows like any
    other; an empty table gives no rows; other columns are ignored."""
    ship(docs.sparkSession)
    langs, known = prototypes(docs.where(F.coalesce(may_learn, F.lit(False)) & F.col(text_col).isNotNull()), text_col, lang_col)
    known = known.astype(np.float32)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, texts in chunks(batch.column(1)):
                own = bundles(texts)
                length = np.linalg.norm(own, axis=1)
                cosine = (own @ known.T) / np.maximum(length, 1e-9)[:, None] if langs else np.zeros((len(texts), 0))
                for row, size in zip(cosine, length, strict=True):
                    blank = size == 0 or not langs
                    names.append(UNKNOWN if blank else langs[int(np.argmax(row))])
                    scores.append(0.0 if blank else float(min(max(row.max(), 0.0), 1.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(job, "doc_id long, lang_pred string, score double")
