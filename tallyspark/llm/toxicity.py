"""Toxicity scores: a learned lexicon, misspellings by automaton, and the context of each hit.

Terms - words, and stems that stand for all words they begin - are learned from a bounded sample of
labelled texts by their log odds, and kept only if they add texts that the terms before them miss. Words of a text that are a term, or a few edits from one, are
hits, unless the sample shows that word in clean texts. A hit inside quotation marks, or after a word
that reports speech, weighs as quotation, others as abuse. A logistic model over these strengths
gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, materialise
from .lexicon_automaton import LexiconAutomaton, allowed_edits
from .quality import SAMPLE, labelled_sample

THRESHOLD = 0.5
#: Texts of class 1 that a term needs, least log odds ratio, and lengths of stems. The sample's size
#: bounds the number of terms.
LEAST_TEXTS, LEAST_ODDS = 8, 3.0
#: Terms that a text of class 1 may have before further ones add nothing.
COVERED = 3
STEMS = range(4, 9)
#: Words before a hit that may report speech.
REPORT_WINDOW = 4
#: Known words, and counts of terms, that a worker holds.
REMEMBERED = 100_000

# Words that report speech or mention a word as such.
REPORTING = frozenset("said says say called calls wrote writes quoted quotes quote word words term phrase shouted reported dit sagte dijo".split())
# Letters that are written as digits or signs.
DISGUISES = str.maketrans("0134578@$", "oieastbas")

_TOKEN = re.compile(r"[\w@$]+")
#: Quotations end with their line at the latest, and may have any length. No search runs over another
#: opening mark, so a text is read once.
_QUOTED = re.compile(r'"[^"\n]+"|“[^“”\n]+”|„[^„“”\n]+[“”]|«[^«»\n]+»')
_DISGUISED = re.compile(r"[0134578@$]")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def plain(token: str) -> str:
    """The token with disguised letters undone, if it has other letters at all."""
    if _DISGUISED.search(token) and any(c.isalpha() for c in token):
        return token.translate(DISGUISES)
    return token


def _parts(text: str) -> set[str]:
    return {w for w in set(tokens(text)) if len(w) > 3 and w.isalpha()}


def _stems(words: set[str]) -> set[str]:
    return {f"{w[:n]}*" for w in words for n in STEMS if n < len(w)}


def _term_counts(wanted: frozenset[str] | None):
    """(term, texts) with each text counted once for a term; of `wanted` terms alone if they are given."""
    begin = {t[: STEMS.start] for t in wanted} if wanted is not None else None

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "texts"])

        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                for text in texts:
                    words = _parts(text)
                    if wanted is None:
                        counts.update(words | _stems(words))
                    else:
                        words = {w for w in words if w[: STEMS.start] in begin}
                        counts.update((words | _stems(words)) & wanted)
                if len(counts) > REMEMBERED:
                    yield out()
                    counts.clear()
        yield out()

    return job


def _held_terms(terms: list[str]):
    """The places in `terms` of those that a text holds, in order."""
    place = {t: i for i, t in enumerate(terms)}

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(place[t] for t in words | _stems(words) if t in place) for _, texts in chunks(batch.column(0)) for words in map(_parts, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32()))], names=["held"])

    return job


def covering(held: list[tuple[list[int], int]], least: int = LEAST_TEXTS, times: int = COVERED) -> list[int]:
    """Terms chosen one by one, each the one that is in most of the texts with fewer than `times` chosen
    terms, as long as those are `least`. `held` has the terms of a text, and how many texts have those.
    What comes along with other terms by chance, as in copies of a text, adds too little."""
    left = [(set(terms), n, 0) for terms, n in held]
    chosen: list[int] = []
    while True:
        more: Counter[int] = Counter()
        for terms, n, _ in left:
            for t in terms:
                more[t] += n
        best = min(more, key=lambda t: (-more[t], t), default=None)
        if best is None or more[best] < least:
            return chosen
        chosen.append(best)
        left = [(terms - {best}, n, seen + (best in terms)) for terms, n, seen in left]
        left = [x for x in left if x[2] < times]


def choose_terms(counts: list[tuple[str, int, float]]) -> list[tuple[str, float]]:
    """(term, weight) from (term, texts of class 1, log odds ratio): of a stem and what goes on from
    it, the longer one if it has nearly all the texts, else the stem."""
    texts = {t: n for t, n, _ in counts}
    weight = {t: w for t, _, w in counts}
    longer: Counter[str] = Counter()
    for t in texts:
        bare = t.removesuffix("*")
        for n in range(STEMS.start, len(bare) + (not t.endswith("*"))):
            if n in STEMS:
                longer[f"{bare[:n]}*"] = max(longer[f"{bare[:n]}*"], texts[t])
    kept = {t for t in texts if not (t.endswith("*") and longer[t] >= 0.95 * texts[t])}
    covered = {t for t in kept if any(f"{t.removesuffix('*')[:n]}*" in kept for n in STEMS if n < len(t.removesuffix("*")))}
    return [(t, weight[t]) for t in sorted(kept - covered, key=lambda t: (-texts[t], t))]


@dataclass
class Lexicon:
    terms: list[str]
    weights: list[float]
    #: Edits that a term allows: none if it has more words near it in texts of class 0 than of class 1.
    edits: list[int]
    #: Words near a term that are words of their own, as texts of class 0 have them.
    harmless: frozenset[str] = frozenset()

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automaton = LexiconAutomaton(lexicon.terms, lexicon.edits)
        self.known: dict[str, tuple[int, int] | None] = {}

    def near(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """(edits, term) of those words that are hits."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        out = {}
        for w in words:
            if w in self.known:
                hit = self.known[w]
            else:
                hit = self.automaton.look_up(plain(w)) if w not in self.lexicon.harmless else None
                if hit and w != plain(w):
                    hit = (max(hit[0], 1), hit[1])
                self.known[w] = hit
            if hit:
                out[w] = hit
        return out

    def hits(self, text: str) -> list[tuple[str, int, int, bool]]:
        """(word, edits, term, quoted) of all hits of the text, in order."""
        low = text.lower()
        near = self.near(set(_TOKEN.findall(low)))
        if not near:
            return []
        quoted = [m.span() for m in _QUOTED.finditer(low)]
        out: list[tuple[str, int, int, bool]] = []
        before, q = [], 0
        for m in _TOKEN.finditer(low):
            w = m.group()
            if w in near:
                while q < len(quoted) and quoted[q][1] <= m.start():
                    q += 1
                inside = q < len(quoted) and quoted[q][0] <= m.start() and m.end() <= quoted[q][1]
                out.append((w, *near[w], inside or not REPORTING.isdisjoint(before)))
            before = [*before[-REPORT_WINDOW + 1 :], w]
        return out

    def strengths(self, text: str) -> list[float]:
        """Abuse by exact terms, abuse by near ones, quotation, and number of distinct exact terms."""
        exact = near = quote = 0.0
        seen = set()
        for _, edits, term, quoted in self.hits(text):
            weight = self.lexicon.weights[term]
            if quoted:
                quote += weight
            elif edits:
                near += weight
            else:
                exact += weight
                seen.add(term)
        return [min(exact, 12.0), min(near, 12.0), min(quote, 12.0), float(min(len(seen), 4))]


#: Where the logistic weights start and are drawn to, and how strongly: abuse counts most, near terms
#: only if there are two, quotation hardly.
PRIOR = np.array([-4.5, 0.9, 0.55, 0.1, 0.3])
PRIOR_STRENGTH = np.array([1.0, 4.0, 400.0, 400.0, 4.0])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bias and weights by Newton steps, drawn to PRIOR."""
    a = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (y - p) - PRIOR_STRENGTH * (w - PRIOR)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(PRIOR_STRENGTH), gradient)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return w


def allow_edits(lexicon: Lexicon, near: list[tuple[str, str, int, int]], ones: int, zeros: int) -> None:
    """Settle edits and harmless words from (term, word, texts of class 1, texts of class 0) of words
    near a term. A word is harmless unless it is as telling as a term has to be, or in no text of
    class 0; a term allows no edits if its harmless words have the greater share of texts."""

    def odds(n1: int, n0: int) -> float:
        return float(np.log((n1 + 0.5) / (ones + 1)) - np.log((n0 + 0.5) / (zeros + 1)))

    lexicon.harmless = frozenset(word for _, word, n1, n0 in near if n0 and odds(n1, n0) < LEAST_ODDS)
    sums: dict[int, np.ndarray] = {}
    for term, _, n1, n0 in near:
        sums[term] = sums.get(term, 0) + np.array([n1, n0])
    for term, (n1, n0) in sums.items():
        if odds(n1, n0) < 0:
            lexicon.edits[term] = 0


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str, text_col: str, label_col: str) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and logistic weights, from at most SAMPLE labelled rows; equal texts count once."""
    wanted = F.broadcast(labelled_sample(labels, may_learn, label_col).withColumnRenamed("doc_id", "_id"))
    sample = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(wanted, "_id")
    sample = materialise(sample.select("text", "y").dropDuplicates(), "toxic_sample")
    size = dict(sample.groupBy("y").count().collect())
    ones, zeros = size.get(1, 0), size.get(0, 0)
    texts = {y: sample.where(F.col("y") == y).select("text") for y in (0, 1)}

    def counted(y: int, wanted: frozenset[str] | None) -> DataFrame:
        return texts[y].mapInArrow(_term_counts(wanted), "term string, texts long").groupBy("term").agg(F.sum("texts").alias("n"))

    n1 = dict(counted(1, None).where(F.col("n") >= LEAST_TEXTS).collect())  # terms of LEAST_TEXTS texts of the sample or more
    n0 = dict(counted(0, frozenset(n1)).collect()) if n1 else {}
    odds = {t: float(np.log((n + 0.5) / (ones + 1)) - np.log((n0.get(t, 0) + 0.5) / (zeros + 1))) for t, n in n1.items()}
    chosen = choose_terms([(t, n1[t], min(odds[t], 6.0)) for t in sorted(n1, key=lambda t: (-n1[t], t)) if odds[t] >= LEAST_ODDS])
    held = texts[1].mapInArrow(_held_terms([t for t, _ in chosen]), "held array<int>").where(F.size("held") > 0).groupBy("held").count().orderBy("held").collect()  # as many rows as texts of class 1 at most
    chosen = [chosen[i] for i in sorted(covering([(r["held"], r["count"]) for r in held]))]
    lexicon = Lexicon([t for t, _ in chosen], [w for _, w in chosen], [allowed_edits(t) for t, _ in chosen])

    def approached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, word, y) once for each text that has the word near the term outside quotations."""
        matcher = lexicon.matcher()
        for batch in batches:
            classes, rows = batch.column(1).to_pylist(), []
            for at, texts in chunks(batch.column(0)):
                for i, text in enumerate(texts):
                    rows += [(term, word, classes[at + i]) for word, term in {(w, t) for w, edits, t, quoted in matcher.hits(text) if edits and not quoted}]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32()))], names=["term", "word", "y"])

    near = sample.mapInArrow(approached, "term int, word string, y int").groupBy("term", "word")
    near = near.agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0")).collect()  # words of the sample near a term
    allow_edits(lexicon, [tuple(r) for r in near], ones, zeros)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            x = [matcher.strengths(t) for _, texts in chunks(batch.column(0)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.mapInArrow(measured, "y int, x array<double>").groupBy("y", "x").count().orderBy("y", "x").collect()
    x = np.repeat(np.array([r["x"] for r in rows]).reshape(-1, len(PRIOR) - 1), [r["count"] for r in rows], axis=0)
    discard(sample)
    return lexicon, fit_logistic(x, np.repeat([r["y"] for r in rows], [r["count"] for r in rows]).astype(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher for class 1), predicted (score >= 0.5).

    `labels` has doc_id and `label_col`; `may_learn` is a condition on its doc_id. Null and empty
    texts get the score of a text without hits. Texts are read whole, however long. Rows of a null or
    repeated id are scored like any other. A word as near to two terms counts for the first of them,
    a score at the threshold as toxic. Without labels there is no term and all score alike, low. An
    empty table gives no rows; other columns are ignored."""
    lexicon, weights = learn(docs, labels, may_learn, id_col, text_col, label_col)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            score = scores(matcher, weights, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(job, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of `docs` that `score_toxicity` does not call toxic, with all their columns, repeated
    rows and those of a null id or text included. An empty table stays empty."""
    lexicon, weights = learn(docs, labels, may_learn, id_col, text_col, label_col)
    at = docs.columns.index(text_col)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            score = scores(matcher, weights, batch.column(at))
            yield batch.filter(pa.array(score < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(job, docs.schema)


def scores(matcher: Matcher, weights: np.ndarray, column: pa.Array) -> np.ndarray:
    x = np.array([matcher.strengths(t) for _, texts in chunks(column) for t in texts]).reshape(len(column), -1)
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))) if len(x) else np.empty(0)
