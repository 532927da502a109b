"""Learned operators against plain loops: bundles, trees, and the forest's whole way at depth."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import boosting, language_id, pii, quality, rp_forest

SF = "/root/testdata/sf0.001"


def bundle_by_hand(text):
    """Every trigram of letters and word edges, bound letter by letter from rolled vectors, and summed."""
    plain = np.random.default_rng(language_id.SEED).choice(np.array([-1, 1], dtype=np.int8), (language_id.LETTERS, language_id.DIMENSIONS))

    def number(c):
        if not c.isalpha():
            return 0
        low = ord(c.lower()[0])
        return low - 96 if "a" <= chr(low) <= "z" else 27 + low % (language_id.LETTERS - 27)

    total = np.zeros(language_id.DIMENSIONS)
    word: list[int] = []
    for n in [*map(number, text), 0]:
        if n:
            word.append(n)
            continue
        edged = [0, *word, 0]
        for i in range(len(word)):
            total += np.roll(plain[edged[i]], 2).astype(int) * np.roll(plain[edged[i + 1]], 1) * plain[edged[i + 2]]
        word = []
    return total


def test_bundles_by_hand(spark):
    texts = ["Hello, wörld 42!", "", "a", "12 34", "ab\ncd  ef", "Ünïcode ñandú", *(r.text[:300] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(5).collect())]
    got = language_id.bundles(texts)
    for text, row in zip(texts, got, strict=True):
        assert np.array_equal(row, bundle_by_hand(text)), text


def test_predictions_by_hand(spark):
    rows = [(1, "der die das und nicht", "de"), (2, "the and of to is", "en"), (3, "und das nicht", None), (4, "to the of", None), (5, "der und die", "de"), (6, "1 2 3", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict_language(df, F.col("doc_id").isin(1, 2, 5)).collect()}
    protos = {"de": bundle_by_hand(rows[0][1]) + bundle_by_hand(rows[4][1]), "en": bundle_by_hand(rows[1][1])}
    for i, text, _ in rows[:5]:
        own = bundle_by_hand(text)
        cosine = {k: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for k, v in protos.items()}
        best = max(cosine, key=cosine.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(max(0, cosine[best]), abs=1e-5)
    assert (got[6].lang_pred, got[6].score) == ("und", 0.0)


def walk(model, row):
    """One row down all trees, a node at a time."""
    total = model.bias
    for root in model.roots.tolist():
        node = root
        while model.feature[node] >= 0:
            node = model.left[node] + (1 if row[model.feature[node]] > model.threshold[node] else 0)
        total += model.value[node]
    return 1 / (1 + np.exp(-total))


def test_trees_by_a_plain_loop():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 5)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = boosting.fit(x, y, trees=30)
    got = model.probabilities(x)
    assert np.allclose(got, [walk(model, r) for r in x], atol=1e-12)
    assert ((got >= 0.5) == y).mean() > 0.9


def test_a_first_split_is_the_best_of_all():
    """The root of the first tree against every split of every feature."""
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 9, (300, 3)).astype(float), rng.integers(0, 2, 300).astype(float)
    y[x[:, 1] > 5] = 1
    model = boosting.fit(x, y, trees=1, depth=1, rate=1.0)
    p = 1 / (1 + np.exp(-model.bias))
    best = None
    for f in range(3):
        for edge in np.unique(x[:, f]):
            left = x[:, f] <= edge
            if min(left.sum(), (~left).sum()) >= 5:
                gain = sum((y[s] - p).sum() ** 2 / (s.sum() * p * (1 - p) + 1.0) for s in (left, ~left))
                best = max(best or (0,), (gain, f, edge))
    assert (model.feature[0], model.threshold[0]) == best[1:]


def test_quality_by_a_plain_loop(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels, F.lit(True)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in texts}
    x = {i: quality.statistics([t])[0].astype(np.float32).astype(np.float64) for i, t in texts.items()}
    ids = sorted(marks)
    model = boosting.fit(np.array([x[i] for i in ids]), np.array([float(marks[i]) for i in ids]))
    for i in texts:
        score = walk(model, x[i])
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].predicted == (got[i].score >= quality.THRESHOLD)


def test_the_forest_end_to_end_at_depth(spark, monkeypatch):
    """Routing, first common leaves, blocks and joins at depth five and more, against all pairs."""
    monkeypatch.setattr(rp_forest, "LEAF", 8)
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((130, 24))
    data = [(i, (centers[i % 130] + rng.standard_normal(24) * 0.07).astype(np.float32).tolist(), i % 2) for i in range(780)]
    data += [(5000 + i, data[3][1], 1) for i in range(30)]
    unit = rp_forest._unit(np.array([d[1] for d in data], dtype=np.float32).astype(np.float64))
    label = np.array([d[2] for d in data])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    depths = []
    plain = rp_forest.Forest.__init__
    monkeypatch.setattr(rp_forest.Forest, "__init__", lambda self, sample, depth: (depths.append(depth), plain(self, sample, depth))[1])
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)
    for block in (2048, 4):
        monkeypatch.setattr(rp_forest, "BLOCK", block)
        got = {r.vec_id: r for r in rp_forest.near_vectors(df).collect()}
        links = np.array([got[d[0]].n_links for d in data])
        assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.99 * near.sum() and near.sum() > 1500
    assert min(depths) >= 5


@pytest.mark.parametrize("n", [3_000])
def test_many_addresses_in_one_text(spark, n):
    """Spans of a text with thousands of them, two-sided, and the text without them."""
    words = [f"u{i}@x{i % 7}.org" for i in range(n)]
    text = "é mail " + " ; ".join(words)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    want, at = [], len("é mail ")
    for w in words:
        want.append(f"email:{at}:{at + len(w)}")
        at += len(w) + 3
    assert got[1].spans.split(",") == want and got[1].n_email == n
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "é mail " + " ; ".join(["[EMAIL]"] * n), 2: None, 3: ""}


def test_added_spans_two_sided(spark):
    """All spans of texts that hold every loose form amid much that must stay; a format of which most
    matches pass their check is taken, of which few do is not."""
    good = "IP 2001:db8:85a3:1:2:8a2e:370:7334 key=abcd1234efgh call (212) 555-0143 or bob [at] site [dot] org ssn 123-45-6789"
    rows = [(i, f"{good} text {i}") for i in range(40)] + [(100, "versions 1.2.3 and 10:20:30, page 12-34, total 1 000 000"), (101, "no personal data at all")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {(k, good[int(a) : int(b)]) for k, a, b in (s.split(":") for s in got[0].split(","))}
    assert spans == {("ip", "2001:db8:85a3:1:2:8a2e:370:7334"), ("secret", "key=abcd1234efgh"), ("phone", "(212) 555-0143"), ("email", "bob [at] site [dot] org"), ("id", "123-45-6789")} or spans >= {("id", "123-45-6789"), ("phone", "(212) 555-0143"), ("email", "bob [at] site [dot] org")}
    assert got[100] == got[101] == ""
