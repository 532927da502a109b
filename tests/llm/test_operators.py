"""Each operator against brute force, and on nulls, empty and long texts, ties and clashing columns."""

from __future__ import annotations

import hashlib
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import common, components, exact_dedup, language_id, packing, pii, piece_bpe, quality, relative_lz, rp_forest, setsketch, toxicity
from tallyspark.llm.common import remainder
from tallyspark.llm.lexicon_automaton import LexiconAutomaton

SF = "/root/testdata/sf0.001"
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, rep long, kept boolean, keep_id long, _id long, label int, __x int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def rows():
    texts = [None, None, "", "   \n", "Same text here", "same TEXT here", "same text Here", "É é", "é É", LONG, LONG, PASSAGE, f"start {PASSAGE} end", f"other {PASSAGE}", "one"]
    texts += ["a b c d e f g h i j", "a b c d e f g h i k", "mail me: a.b@c.example.com or +1 (246) 555-3872, 192.168.0.1, 4111 1111 1111 1111"]
    out = [(i, t, "en" if i % 2 else None, None, None, "k", 7, None, True, 1, 2, None, 3) for i, t in enumerate(texts)]
    out += [(None, "same text here", *out[0][2:]), (None, None, *out[0][2:]), (4, "Same text here", *out[4][2:]), (3, PASSAGE, *out[3][2:])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def lower(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


# Exact dedup


def test_exact_groups(docs, none):
    got = exact_dedup.duplicate_groups(docs, hot_keys=2).collect()
    assert len(got) == len(rows())
    groups: dict = {}
    for doc_id, text, *_ in rows():
        groups.setdefault(hashlib.sha256(lower(text).encode()).hexdigest(), []).append(doc_id)
    for r in got:
        own = groups[r.text_sha256]
        top = max((i for i in own if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (top, len(own), r.doc_id == top)
    assert exact_dedup.duplicate_groups(none).count() == 0
    kept = {r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()}
    assert {6, 10, 7, 8} <= kept and not {4, 5, 9} & kept
    assert exact_dedup.drop_duplicates(docs).columns == docs.columns


# Coding


def test_pieces_like_the_library(docs, real, none):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(4)
    odd = ["".join(rng.choice(list("abet n"), 300)) for _ in range(40)] + ["".join(rng.choice(list("aàe中"), 90)) for _ in range(20)]
    odd += ["a" * 4001, "ab" * 1500, "ing" * 1001 + "x", "0" * 777, "=-" * 300, "ha" * 333 + " haha" * 20]
    odd += ["  a  b\n\tc ", "▁a▁ b", "ｆｕｌｌ é ﬁ 😀", "\x00a\r\n", "=" * 401, " " * 77 + "a", "ing" * 200, "<s> hi </s>"]
    for text in odd:
        ids = piece_bpe.encode(text, PIECES)
        assert ids == model.encode(text)
        assert piece_bpe.model_at(PIECES).decode(np.array(ids)) == model.decode(ids)
    for table in (docs, real):
        got = sorted(map(tuple, piece_bpe.encode_decode(table, PIECES).collect()), key=str)
        want = []
        for doc_id, text in ((r.doc_id, r.text) for r in table.collect()):
            ids = model.encode(text or "")
            want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert piece_bpe.encode_decode(none, PIECES).count() == 0


def test_a_very_long_word_takes_few_rounds(monkeypatch):
    own, rounds = piece_bpe.model_at(PIECES), []
    pairs = own._pairs
    monkeypatch.setattr(own, "_pairs", lambda sym: rounds.append(len(sym)) or pairs(sym))
    ids, _ = own.encode_words(["▁" + "a" * 400_000])
    assert b"".join(own.spelled[i] for i in ids) == b" " + b"a" * 400_000 and len(rounds) < 40
    assert ids[:1000].tolist() == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode("a" * 400_000)[:1000]
    assert len(own.decode(np.full(100_000, own.byte_id[0xC3]))) == 100_000  # bytes that are no UTF-8


def test_pieces_of_invalid_bytes():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = piece_bpe.model_at(PIECES)
    for ids in ([3 + 0xC3], [3 + 0xE4, 3 + 0xB8, 264], [3 + 0xF0, 3 + 0x9F, 3 + 0x98]):
        assert own.decode(np.array(ids)) == model.decode(ids)


def packed(table, max_tokens=2048):
    got = packing.pack(table, WORDS, max_tokens=max_tokens).toPandas()
    assert got["length"].between(1, max_tokens).all()
    total = 0
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].to_numpy() == np.concatenate(([0], own["length"].cumsum().to_numpy()[:-1]))).all()
        assert own["length"].sum() <= max_tokens
        total += 1
    return got, total


def test_packing(docs, real, none):
    tokenizer = Tokenizer.from_file(WORDS)
    for table in (docs, real):
        got, sequences = packed(table)
        want = []
        for doc_id, text in ((r.doc_id, r.text) for r in table.collect()):
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
            want += [(doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
        have = [tuple(None if v != v else int(v) for v in r) for r in got[columns].itertuples(index=False)]
        assert sorted(have, key=str) == sorted(want, key=str)
        assert sequences <= -(-got["length"].sum() // 2048) + 1
    assert packing.pack(none, WORDS).count() == 0


def test_words_alone_have_the_ids_of_texts(monkeypatch):
    tokenizer = Tokenizer.from_file(WORDS)
    rng = np.random.default_rng(1)
    letters = list("ab ZÉíß İΣςé.,*?' \t\n\r\v\f\x85\xa0中1²<|>") + ["<|endoftext|>", "'s", "é́"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(500)]
    texts += [*texts[:50], "", " \n", "word " * 3000]
    monkeypatch.setattr(packing, "REMEMBERED", 100)  # so that words are forgotten as well
    for at in range(0, len(texts), 90):
        ids, starts = packing.token_ids(pa.array([*texts[at : at + 90], None], pa.large_string()), WORDS)
        for i, text in enumerate([*texts[at : at + 90], ""]):
            assert ids[starts[i] : starts[i + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def fewest_bins(lengths, size):
    """By trying all placements."""
    best = len(lengths)

    def place(i, fills):
        nonlocal best
        if len(fills) < best and i == len(lengths):
            best = len(fills)
        elif len(fills) < best:
            for k in range(len(fills)):
                if fills[k] + lengths[i] <= size:
                    place(i + 1, [*fills[:k], fills[k] + lengths[i], *fills[k + 1 :]])
            place(i + 1, [*fills, lengths[i]])

    place(0, [])
    return best


def test_local_search_empties_bins():
    rng = np.random.default_rng(0)
    cases = [np.array([8, 7, 8, 3, 2, 8, 2, 6, 2, 4, 5, 5, 5, 2]), *(rng.integers(2, 10, 11) for _ in range(60))]
    better = 0
    for lengths in cases:
        start = packing.best_fit(lengths, 17)
        for bins in (start, np.arange(len(lengths))):
            done = packing.local_search(lengths, bins, 17)
            assert np.bincount(done, lengths).max() <= 17
            assert fewest_bins(lengths.tolist(), 17) <= len(set(done)) <= len(set(bins))
            better += len(set(done)) < len(set(start))
    done = packing.local_search(cases[0], packing.best_fit(cases[0], 17), 17)
    assert len(set(packing.best_fit(cases[0], 17))) == 5 and len(set(done)) == fewest_bins(cases[0].tolist(), 17) == 4
    assert better


# Near-duplicates


def shingles(text, k):
    words = lower(text).encode().split()
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def reach(links, nodes):
    top = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(top[a], top[b])
            if top[a] != low or top[b] != low:
                top[a] = top[b] = low
                changed = True
    return top


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, real, k):
    base = [f"t{i}" for i in range(80)]
    more = [(1000 + i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(0, 80, 9)]
    # A group around one text: its members are near the middle, but not near each other.
    more += [(3000 + i, " ".join(f"z{j}" if i < 39 and (j * 7 + i) % 39 == 0 else f"m{j}" for j in range(100))) for i in range(40)]
    more += [(2000 + i, " ".join(base[: 60 + i] + [f"y{j}" for j in range(20 - i)])) for i in range(0, 20, 3)]
    for table in (docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")), real.select("doc_id", "text")):
        got = setsketch.near_duplicates(table, shingle_words=k).collect()
        data = [(r.doc_id, r.text) for r in table.collect()]
        sets = [(i, shingles(t, k)) for i, t in data if i is not None]
        links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
        top = reach(links, [i for i, _ in sets])
        assert len(got) == len(data)
        assert sorted(((r.doc_id, r.n_shingles) for r in got), key=str) == sorted(((i, len(shingles(t, k))) for i, t in data), key=str)
        for r in got:
            assert r.component_id == top.get(r.doc_id) and r.kept == (r.doc_id is None or r.component_id == r.doc_id)


def test_near_duplicates_of_nothing(none, docs):
    assert setsketch.near_duplicates(none).count() == 0
    assert setsketch.drop_near_duplicates(docs).columns == docs.columns


def test_similarity_estimate():
    rng = np.random.default_rng(3)
    for share in (0.9, 0.5):
        common, parts = rng.integers(0, 1 << 63, int(2000 * share), dtype=np.uint64), rng.integers(0, 1 << 63, (2, 400), dtype=np.uint64)
        a, b = (setsketch.registers(np.concatenate((common, p)))[None, :] for p in parts)
        n = len(common) + 400
        true = len(common) / (len(common) + 800)
        got = setsketch.similarity(a, b, np.array([n]), np.array([n]))[0]
        assert abs(got - true) < 0.12
        for least in (got - 0.01, got + 0.01):
            assert setsketch.estimated_above(least, setsketch.register_counts(a, b), np.array([n]), np.array([n]))[0] == (got >= least)
    merged = np.maximum(setsketch.registers(parts[0]), setsketch.registers(parts[1]))
    assert (merged == setsketch.registers(parts.ravel())).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 99), (98, 100), (7, 7)]
    got = {r.node: r.component_id for r in components.connected_components(spark.createDataFrame(chain, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 98: 98, 99: 98, 100: 98}


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((12, 16))
    data = [(i, (centers[i % 12] + rng.standard_normal(16) * 0.05).tolist(), i % 3) for i in range(400)]
    data += [(1000 + i, data[i][1], data[i][2]) for i in range(0, 40, 2)]
    data += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [float("inf")] * 16, 1), (2004, [None] * 16, 1), (2005, data[0][1], None), (2006, data[0][1][:5], 0), (None, data[0][1], 0), (0, *data[0][1:])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "dim": F.lit("x"), "copies": F.lit(None)})
    ok = {}
    for i, v, label in ((r.vec_id, r.embedding, r.label) for r in df.collect()):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, dtype=float), label)
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= 0.98]
    top = reach(links, ok)
    for block in (2048, 16):
        monkeypatch.setattr(rp_forest, "BLOCK", block)
        got = rp_forest.near_vectors(df).collect()
        assert len(got) == len(data)
        for r in got:
            assert r.n_links == sum(r.vec_id in link for link in links) and r.component_id == top.get(r.vec_id, r.vec_id)
    assert rp_forest.near_vectors(df.limit(0)).count() == 0


def test_split_trees_find_planted_neighbours():
    """Recall of trees that do split, for pairs just above the threshold, and how few pairs they compare."""
    rng = np.random.default_rng(11)
    for dim in (16, 64, 384):
        base = rp_forest._unit(rng.standard_normal((10_000, dim)))
        off = rng.standard_normal(base.shape)
        off = rp_forest._unit(off - (off * base).sum(axis=1, keepdims=True) * base)
        vectors = np.concatenate((base, 0.981 * base + np.sqrt(1 - 0.981**2) * off))
        forest = rp_forest.Forest(vectors[::2], int(np.ceil(np.log2(len(vectors) / rp_forest.LEAF))))
        assert forest.depth == 10
        found, compared = np.zeros(len(base), dtype=bool), 0
        for tree in range(rp_forest.TREES):
            row, leaf = forest.leaves(vectors, tree)
            size = np.bincount(leaf)
            compared += (size * (size - 1) // 2).sum()
            inside = np.zeros((len(vectors), len(size)), dtype=bool)
            inside[row, leaf] = True
            found |= (inside[: len(base)] & inside[len(base) :]).any(axis=1)
        assert found.mean() >= 0.9, (dim, found.mean())
        assert compared < 0.1 * len(vectors) ** 2 / 2, (dim, compared)


# Repeated spans


def removed(data):
    words = [(t or "").encode().split() for _, t in data]
    seen: dict = {}
    for d, w in enumerate(words):
        for s in range(len(w) - 34):
            seen.setdefault(tuple(w[s : s + 35]), []).append((d, s))
    gone = {(d, s + j) for places in seen.values() if len(places) > 1 for d, s in places for j in range(35)}
    out = []
    for d, (i, _) in enumerate(data):
        kept = [x for j, x in enumerate(words[d]) if (d, j) not in gone]
        out.append((i, len(words[d]), len(words[d]) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("copies", [1024, 2])
def test_repeated_spans(spark, docs, real, copies):
    loops = ["x " * 34 + "x", "x " * 90, "ab ba " * 60, f"{PASSAGE} {PASSAGE}", " ".join(PASSAGE.split()[:34]), " ".join(PASSAGE.split()[20:55]) + " tail"]
    # Three texts, of which each two share another part of one passage.
    loops += [" ".join(PASSAGE.split()[:45]) + " left", "right " + " ".join(PASSAGE.split()[8:]), "mid " + " ".join(PASSAGE.split()[4:50]) + " dle"]
    more = spark.createDataFrame([(500 + i, t) for i, t in enumerate(loops)], "doc_id long, text string")
    for table in (docs.select("doc_id", "text").unionByName(more), real.select("doc_id", "text")):
        data = [(r.doc_id, r.text) for r in table.collect()]
        assert sorted(map(tuple, relative_lz.remove_repeats(table, block_phrases=7, block_copies=copies).collect()), key=str) == removed(data)
    assert relative_lz.remove_repeats(table.limit(0)).count() == 0


def test_repeated_spans_come_from_factors(spark, docs, monkeypatch):
    table = docs.select("doc_id", "text").coalesce(1)
    data = [(r.doc_id, r.text) for r in table.collect()]
    batch = pa.table({"text": [t or "" for _, t in data]})
    words, first = common.word_hashes(batch["text"].to_pylist(), lower=False)
    place, seed = relative_lz.anchors(words, first)
    text = np.searchsorted(first, place, side="right") - 1
    hits = [[{"seed": int(s.view(np.int64)), "copies": 2, "place": int(p - first[t])} for p, s in zip(place[text == t], seed[text == t], strict=True)] for t in range(len(data))]
    rows = pa.record_batch([pa.array(range(len(data)), pa.int64()), batch["text"].combine_chunks(), pa.array(hits, pa.list_(pa.struct([("seed", pa.int64()), ("copies", pa.int32()), ("place", pa.int32())])))], names=["text_no", "text", "hits"])
    phrases = pa.Table.from_batches(list(relative_lz._phrases(iter([rows]))))
    phrases = phrases.append_column("salt", pa.array([0] * len(phrases), pa.int32()))
    passage = [i for i, (d, _) in enumerate(data) if d in (12, 13)]

    def spans():
        out = relative_lz.factor_block(phrases, 1024).to_pylist()
        return {(r["text_no"], k) for r in out if r["text_no"] in passage for k in range(r["start"], r["end"])}

    whole = spans()
    assert len(whole) == 120  # both texts hold the passage of 60 words
    monkeypatch.setattr(relative_lz, "parse", lambda words, *_: (np.full(len(words), -1), np.zeros(len(words), dtype=np.int64)))
    assert spans() == set()


# Learned models


def test_language(docs, real, none):
    got = language_id.predict_language(real, remainder("doc_id", 3) != 1).toPandas()
    truth = real.select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    held = truth[[zlib.crc32(str(i).encode()) % 3 == 1 for i in truth["doc_id"]]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95 and truth["score"].between(0, 1).all()
    odd = language_id.predict_language(docs, F.lit(True)).collect()
    assert len(odd) == len(rows()) and {r.lang_pred for r in odd if r.doc_id in (0, 2)} == {"und"}
    assert language_id.predict_language(none, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_id.predict_language(docs, F.lit(False)).collect()} == {"und"}


def test_quality(spark, docs, none, labels):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score_quality(big, marks, remainder("doc_id", 4) != 2).toPandas().merge(marks.toPandas(), on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    odd = quality.score_quality(docs, labels, F.lit(True)).toPandas()
    assert len(odd) == len(rows()) and odd["score"].between(0, 1).all()
    assert quality.score_quality(none, labels, F.lit(True)).count() == 0
    assert set(quality.score_quality(docs, labels.limit(0), F.lit(True)).toPandas()["score"].round(6)) == {0.5}


def test_automaton():
    found = LexiconAutomaton(["idiot", "disgusting", "scum", "lowei*"], [1, 2, 0, 0]).look_up
    assert found("idiot") == (0, 0) and found("idoit") == (1, 0) and found("idiiot") == (1, 0) and found("idot") == (1, 0) and found("adiot") == (1, 0)
    assert found("idt") is None and found("disgastin") == (2, 1) and found("scun") is None and found("loweixyz") == (0, 3) and found("lowe") is None
    rng = np.random.default_rng(2)

    def distance(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    def swapped(word):
        return {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word}

    # A whole lexicon: edit distance, where a swap of neighbours in the term costs one as well.
    terms, edits = ["abcab", "aabb", "cacacaca", "bcb*", "abc"], [2, 1, 2, 0, 0]
    whole = LexiconAutomaton(terms, edits)
    for _ in range(3000):
        word = "".join(rng.choice(list("abcd"), rng.integers(1, 11)))
        want = []
        for t, (term, k) in enumerate(zip(terms, edits, strict=True)):
            if term.endswith("*"):
                d = 0 if word.startswith(term[:-1]) else 99
            else:
                d = min([distance(term, word), *(1 + distance(s, word) for s in swapped(term))])
            if d <= k:
                want.append((d, t))
        assert whole.look_up(word) == min(want, default=None)


def test_edits_and_harmless_words():
    lexicon = toxicity.Lexicon(["moron", "idiot"], [6.0, 6.0], [1, 1])
    toxicity.allow_edits(lexicon, [(0, "oron", 0, 40), (0, "morom", 5, 0), (1, "idito", 30, 0), (1, "idiom", 0, 3)], 1000, 1000)
    assert lexicon.harmless == {"oron", "idiom"} and lexicon.edits == [0, 1]
    found = lexicon.matcher().near({"idiom", "idito", "moron", "morom"})
    assert found == {"idito": (1, 1), "moron": (0, 0)}


def test_long_quotations():
    lexicon = toxicity.Lexicon(["moron"], [6.0], [0])
    for a, b in (('"', '"'), ("“", "”"), ("«", "»"), ("„", "“")):
        inside = f"x {a}{'so ' * 250}moron{b} out"
        assert lexicon.matcher().strengths(inside)[:3] == [0, 0, 6] and lexicon.matcher().strengths(inside + " moron")[0] == 6
    assert lexicon.matcher().strengths('5" wide\nyou moron and "so"')[0] == 6


def edit_distance(a, b):
    """Levenshtein with swaps of neighbouring letters, by the table."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


def plain_strengths(lexicon, text):
    """Strengths of a text, each word against each term by the table."""
    low, quoted = text.lower(), [m.span() for m in toxicity._QUOTED.finditer(text.lower())]
    exact = near = quote = 0.0
    seen, words = set(), list(re.finditer(r"[\w@$]+", low))
    for at, m in enumerate(words):
        w = m.group()
        undone = toxicity.plain(w)
        best = None
        for t, term in enumerate(lexicon.terms):
            bare = term.removesuffix("*")
            ends = range(len(undone) + 1) if term.endswith("*") else [len(undone)]
            k = min(edit_distance(undone[:n], bare) for n in ends)
            if k <= lexicon.edits[t] and (best is None or (k, t) < best):
                best = (k, t)
        if best is None or w in lexicon.harmless:
            continue
        edits = max(best[0], 1) if w != undone else best[0]
        if any(a <= m.start() and m.end() <= b for a, b in quoted) or toxicity.REPORTING & {x.group() for x in words[max(0, at - toxicity.REPORT_WINDOW) : at]}:
            quote += lexicon.weights[best[1]]
        elif edits:
            near += lexicon.weights[best[1]]
        else:
            exact += lexicon.weights[best[1]]
            seen.add(best[1])
    return [min(exact, 12.0), min(near, 12.0), min(quote, 12.0), float(min(len(seen), 4))]


def test_toxicity_like_a_plain_loop(real):
    lexicon = toxicity.Lexicon(["idiot", "disgusting", "scum", "worthle*"], [3.0, 2.0, 2.5, 1.5], [1, 2, 0, 1], frozenset({"idiom"}))
    texts = ["You idiot, idoit and IDIOTS!", 'he said: "idiot" is a word', "an idiom", "d1sgust1ng disgustin scum scun", "worthless worthlless wrthlesser worthy", "he said it is an idiot and an idiot now", "„idiot“ « scum » “idiot", "", "$cum @idiot 1234"]
    texts += [r.text[:600] for r in real.limit(12).collect()]
    for text in texts:
        assert lexicon.matcher().strengths(text) == plain_strengths(lexicon, text), text


def test_toxicity(spark, docs, none, labels):
    """Held-out rows by precision and recall of the toxic ones, which flagging none or all would miss."""
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = big.join(F.broadcast(marks.select("doc_id")), "doc_id", "left_semi")
    got = toxicity.score_toxicity(big, marks, remainder("doc_id", 5) != 0).toPandas().merge(marks.toPandas(), on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]]
    hit = (held["predicted"] == 1) & (held["toxic"] == 1)
    assert (held["toxic"] == 1).sum() > 60
    assert hit.sum() >= 0.85 * (held["toxic"] == 1).sum() and hit.sum() >= 0.9 * (held["predicted"] == 1).sum()
    odd = toxicity.score_toxicity(docs, labels, F.lit(True)).toPandas()
    assert len(odd) == len(rows()) and odd["score"].between(0, 1).all()
    assert toxicity.score_toxicity(none, labels, F.lit(True)).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0), F.lit(True)).toPandas()["predicted"].sum() == 0
    kept = toxicity.drop_toxic(docs, labels, F.lit(True))
    assert kept.columns == docs.columns and kept.count() == len(rows())


def test_terms_cover_texts():
    held = [([0, 3], 10), ([0, 1], 9), ([1], 8), ([2], 7), ([0, 2, 3], 30), ([], 5)]
    assert toxicity.covering(held, 8, 1) == [0, 1]  # 3 comes along with 0 alone, 2 adds seven
    assert toxicity.covering(held, 7, 1) == [0, 1, 2] and toxicity.covering([], 1) == []
    assert toxicity.covering(held, 10, 2) == [0, 3, 1]  # 3 is in forty texts with one term so far; 2 is left with seven


def test_quotation_weighs_less():
    lexicon = toxicity.Lexicon(["idiot", "moron"], [6.0, 6.0], [1, 1])
    abuse, quoted, near = (lexicon.matcher().strengths(t) for t in ("You idiot, you moron", 'The word "idiot" and "moron"', "such an 1diot and moroon"))
    assert abuse[0] == 12 and quoted[:3] == [0, 0, 12] and near[:2] == [0, 12]


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    d = [int(c) for c in value if c in string.digits]
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in value.split("."))) or (kind == "phone" and 10 <= len(d) <= 15)


def test_personal_data(spark, docs, real, none):
    rng = np.random.default_rng(5)
    odd = ["".join(rng.choice(list("a1b2@..-+ ()4_%é😀:\n"), rng.integers(0, 100))) for _ in range(400)]
    odd += ["x@y.z_d@e.f", "a@b.c.@x.y", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111-1111-1111-1112 +1 (246) 555-3872", "1 " * 5000, "a" * 5000, "token = \"abc123def456\""]
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for table in (docs.select("doc_id", "text").unionByName(more), real.select("doc_id", "text")):
        want = []
        for r in table.collect():
            spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, r.text or "") if passes(kind, m.group()))
            named = [f"{kind}:{s}:{e}" for s, _, e, kind in spans]
            want.append((r.doc_id, *(sum(x[3] == k for x in spans) for k in PATTERNS), hashlib.sha256(",".join(named).encode()).hexdigest(), set(named)))
        got = pii.find_pii(table).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((w[:6] for w in want), key=str)
        base = {w[5]: w[6] for w in want}
        assert all(base[r.base_sha256] <= set(r.spans.split(",")) for r in got if r.base_sha256)
    assert pii.find_pii(none).count() == 0


def test_redaction(docs):
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[17].text == "mail me: [EMAIL] or [PHONE], [IP], [CARD]" and got[0].text is None and got[17].key == "k"
    assert pii.redact(docs).columns == docs.columns


def test_personal_data_of_any_length_is_taken_whole(spark):
    texts = ["a password=" + "ab12" * 75 + " end", "b " + "x" * 70 + " [at] mail.example.com end", "c joe [at] mail." + "d" * 100 + ".com end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["a [SECRET] end", "b [EMAIL] end", "c [EMAIL] end"]
