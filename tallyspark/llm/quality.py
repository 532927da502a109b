"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts in one pass. The trees are fitted on the driver to a sample of
labelled rows that `SAMPLE` bounds, and score all rows on the executors, as flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import chunks, materialise, runs, word_hashes, word_spans

#: Labelled rows that are learned from at most: those of the least hashes of their ids.
SAMPLE = 20_000
THRESHOLD = 0.7

STATISTICS = (
    "log_bytes", "log_words", "bytes_per_word", "share_upper", "share_lower", "share_digit", "share_other_ascii", "share_high", "share_space", "share_line_end",
    "share_stop", "share_comma", "share_bar", "share_mark", "distinct_words", "top_word", "repeats_before", "distinct_pairs", "long_words", "short_words",
    "distinct_lines", "words_per_line", "upper_words", "deviation_of_word_length", "distinct_triples", "same_at_short_distance",
)

_KINDS = np.zeros((256, 10), dtype=np.float32)
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"", bytes(range(128, 256)), b" \t\r\v\f", b"\n", b".!?", b",;:", b"|")):
    _KINDS[list(_bytes), _kind] = 1
_KINDS[[c for c in range(33, 127) if not _KINDS[c].any()], 3] = 1


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS for each text; zeros for an empty one."""
    raw, starts, ends, first = word_spans(texts, lower=False)
    hashes, _ = word_hashes(texts, lower=True)
    sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(sizes)))
    lengths = (ends - starts).astype(np.float64)
    capital = _KINDS[raw[starts], 0] > 0 if len(starts) else np.empty(0, bool)
    out = np.zeros((len(texts), len(STATISTICS)), dtype=np.float32)
    for i in range(len(texts)):
        own = raw[at[i] : at[i + 1] - 1]
        if not len(own):
            continue
        share = np.bincount(own, minlength=256).astype(np.float32) @ _KINDS / len(own)
        a, b = first[i], first[i + 1]
        n = b - a
        row = [np.log1p(len(own)), np.log1p(n), len(own) / max(n, 1), *share[:7], share[7], share[8], share[9]]
        marks = np.isin(own, np.frombuffer(b"#$%&*<>{}[]\\^~_=+@!", dtype=np.uint8)).mean()
        if n:
            h, size = hashes[a:b], lengths[a:b]
            _, count = np.unique(h, return_counts=True)
            lines = texts[i].split("\n")
            pairs, triples = runs(h, 2), runs(h, 3)
            row += [marks, len(count) / n, count.max() / n, (h[1:] == h[:-1]).mean() if n > 1 else 0.0, len(np.unique(pairs)) / max(len(pairs), 1), (size > 12).mean(), (size < 3).mean()]
            row += [len(set(lines)) / len(lines), n / len(lines), capital[a:b].mean(), size.std(), len(np.unique(triples)) / max(len(triples), 1)]
            row += [max((h[d:] == h[:-d]).mean() for d in range(1, 4)) if n > 3 else 0.0]
        else:
            row += [marks] + [0.0] * 12
        out[i] = row
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in chunks(batch.column(1)):
            flat = pa.array(statistics(texts).ravel())
            rows = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(STATISTICS), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), rows], names=["doc_id", "stats"])


def labelled_sample(labels: DataFrame, may_learn: Column, label_col: str) -> DataFrame:
    """doc_id and y (0 or 1) of at most SAMPLE labelled ids. An id with several labels counts as 1
    if any is 1; null ids and labels are left out."""
    found = labels.where(may_learn & F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    found = found.groupBy("doc_id").agg(F.max(F.col(label_col)).cast("int").alias("y"))
    return found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)


def score_quality(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher for class 1), predicted (score >= 0.7).

    `labels` has doc_id and `label_col`; `may_learn` is a condition on its doc_id. Null and empty
    texts get the score of a text without statistics. Rows of a null or repeated id are scored like
    any other, and the fit takes at most 2 * SAMPLE of them. Texts are read whole, however long; a score
    at the threshold counts as 1. Without a label the score is 0.5 for all. An empty table gives no
    rows; other columns are ignored."""
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measured, "doc_id long, stats array<float>")
    measured = materialise(measured, "statistics")
    sample = measured.join(F.broadcast(labelled_sample(labels, may_learn, label_col)), "doc_id").orderBy("doc_id").limit(2 * SAMPLE).toPandas()
    x = np.array(sample["stats"].tolist(), dtype=np.float32).reshape(-1, len(STATISTICS)).astype(np.float64)
    model = boosting.fit(x, sample["y"].to_numpy(dtype=float))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            score = model.probabilities(stats)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return measured.mapInArrow(job, "doc_id long, score double, predicted int")
