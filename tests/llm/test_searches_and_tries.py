"""Prefix trie, phrases and top-k against brute force, and on nulls, ties, repeats and odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import phrases, prefix_trie, queries, scan, top_k

from ..test_helpers import same_rows

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_phrases", "op13_top_k"])
def test_query_like_its_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def test_running_values_over_ranges_of_any_key(spark):
    rng = random.Random(5)
    rows = [(7 if rng.random() < 0.6 else rng.randrange(-3, 3), rng.randrange(10**6), rng.randrange(-(1 << 62), 1 << 62)) for _ in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges for the hot key
    try:
        got = scan.running(spark.createDataFrame(rows, "k long, o long, v long").withColumn("one", scan.F.lit(1).cast("long")), "k", ["k", "o", "v"], {"n": "one", "s": "o"}, {"x": "v"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, have = set(), defaultdict(lambda: [0, 0, 0])
    for k, o, v in sorted(rows):
        mine = have[k]
        mine[0], mine[1], mine[2] = mine[0] + 1, mine[1] + o, mine[2] ^ v
        want.add((k, o, v, *mine))
    assert {(r.k, r.o, r.v, r.n, r.s, r.x) for r in got} == want


# Prefix trie

TURNS = "conv_id long, turn long, role string, text string, place int, key string, words string, h1 long, n_convs int, depth string"


def trie_of(rows):
    """By the contract, with every conversation's turns in lists."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + mine[h:])
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)
    out = set()
    for node, members in nodes.items():
        leaves, saved, todo = 0, 0, [node]
        while todo:
            x = todo.pop()
            todo += children.get(x, [])
            leaves += not children.get(x)
            saved += (len(nodes[x]) - 1) * len(re.findall(rb"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = ",".join(str(c) for c in sorted(members) if built[c] == node)
        out.add((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_by_spark(spark, rows):
    df = spark.createDataFrame([(*r, 1, "k", "w", 5, 9, "d") for r in rows], TURNS).repartition(3)
    out = prefix_trie.prefix_trie(*prefix_trie.with_shared_beginnings(prefix_trie.numbered_turns(df))).collect()
    return out


def values(out):
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out}


def random_turns():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "A b", "c", "", None, "é \x0b x"])) for c in range(-30, 90) if c % 7 for t in range(rng.choice([0, 1, 2, 3, 6]))]
    rows += [(100 + i, t, "user", f"same {t}") for i in range(40) for t in range(3)]  # copies
    rows += [(5, None, "late", "null turn"), (5, None, None, None), (6, 1, "x", "tie"), (6, 1, "x", "tie"), (None, 0, "user", "nobody's"), (87, 0, None, None)]
    rows += [(85, t, "user", f"t{t} " * 3) for t in range(500)]  # a conversation with a third of all rows
    return rows


def test_trie_like_brute_force(spark):
    rows = random_turns()
    out = trie_by_spark(spark, rows)
    assert values(out) == trie_of(rows)
    assert len(out) == len(values(out))
    # Intervals nest, and a subtree is as long as its interval.
    ends = {r.first_place: r.last_place for r in out}
    assert sorted(ends) == list(range(1, len(out) + 1))
    top = []
    for first in sorted(ends):
        while top and ends[top[-1]] < first:
            top.pop()
        assert not top or ends[first] <= ends[top[-1]]
        top.append(first)


def test_trie_of_a_hot_conversation_over_ranges(spark):
    rows = random_turns()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert values(trie_by_spark(spark, rows)) == trie_of(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_ends_in_several_texts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "END_IDS", 7)
    rows = [(i, 0, "user", "all alike") for i in range(60)]
    assert values(trie_by_spark(spark, rows)) == trie_of(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "a", "b")], [(5, 0, "a", "b")], [(3, 0, "a", "b")], [(-1, None, None, None), (-2, None, None, None)]])
def test_trie_of_small_tables(spark, rows):
    assert values(trie_by_spark(spark, rows)) == trie_of(rows)


# Phrases

DOCS = "doc_id long, text string, lang string, a long, f int, phrase string, part int, n int, w1 string"


def phrases_of(rows, least, top, longest=3, share=50):
    out = []
    by = defaultdict(list)
    for text, lang in rows:
        by[lang if lang is not None else "und"] += [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]
    for lang, pieces in by.items():
        f = Counter(tuple(p[i : i + d]) for p in pieces for d in range(1, longest + 1) for i in range(len(p) - d + 1))
        n = sum(map(len, pieces))
        cands = {x: a for x, a in f.items() if len(x) > 1 and a >= least}
        rows_ = []
        for x, a in cands.items():
            if any(len(y) > len(x) and 100 * b >= share * a and any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1)) for y, b in cands.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (f[x[:k]] * f[x[k:]]), k, f[x[:k]], f[x[k:]]) for k in range(1, len(x)))
            rows_.append((-score, -a, " ".join(x).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


def phrases_by_spark(spark, rows, **options):
    df = spark.createDataFrame([(i, *r, 1, 2, "p", 3, 4, "x") for i, r in enumerate(rows)], DOCS).repartition(3)
    out = phrases.mine_phrases(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    return sorted(tuple(r) for r in out)


def random_texts():
    rng = random.Random(11)
    words = ["the", "The", "of", "x", "é", "É", "a\x01", "a", "a\x00b", "zz", "\x7f"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!?"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(80)]
    rows += [(None, "en"), ("", None), (" \n.", "fr"), ("ends . starts", "en"), ("word", "de")] + [("one two three. one two four", "en")] * 6
    return rows + [("long time no see " * 4000, "en")]


def test_phrases_like_brute_force(spark):
    rows = random_texts()
    assert phrases_by_spark(spark, rows, least=3, top=30) == phrases_of(rows, 3, 30)
    assert phrases_by_spark(spark, rows, least=4, longest=4, top=10**6) == phrases_of(rows, 4, 10**6, longest=4)


def test_phrases_in_small_steps_over_ranges(spark, monkeypatch):
    rows = random_texts()
    for name, value in (("SHARD_BYTES", 500), ("MOST_BITS", 1 << 10)):
        monkeypatch.setattr(phrases, name, value)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert phrases_by_spark(spark, rows, least=3, top=30) == phrases_of(rows, 3, 30)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_phrases_of_nothing(spark):
    assert phrases_by_spark(spark, []) == []
    assert phrases_by_spark(spark, [(None, None), ("a b c", "en")]) == []


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_000)], "a long, l long, r long").selectExpr(*(f"CAST({c} AS DECIMAL(15,0)) AS _{c}" for c in "alr"))
    assert df.selectExpr("(_a * _a * 1000000) div (_l * _r)").first()[0] == 450_000


# Top-k

VECTORS = "vec_id long, embedding array<float>, label int, query long, score long, rank string, block int, dim string"


def best_of(rows, k, every):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def best_by_spark(spark, rows, k=5, every=10):
    df = spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], 1, 2, 3, "r", 4, "d") for i, v in rows], VECTORS).repartition(3)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(df, every=every, k=k).collect())


def random_vectors():
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).astype(float).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[40][1]) for i in range(300)]  # a group of equal vectors
    rows += [(450, None), (None, rows[1][1]), (460, [1.0, None, 1, 1, 1, 1]), (470, [math.nan] * 6), (480, [math.inf, 0, 0, 0, 0, 0]), (490, [0.0] * 6), (500, [-0.001] * 6), (510, []), (511, [])]
    return rows + [(520, [1.0, 2.0]), (521, [2.0, 1.0]), (530, [1.0, 1.0, 1.0]), (7, rows[7][1]), (0, rows[0][1])]


def test_top_k_like_brute_force(spark):
    rows = random_vectors()
    assert best_by_spark(spark, rows) == best_of(rows, 5, 10)


def test_top_k_in_many_blocks_and_rounds(spark, monkeypatch):
    for name, value in (("BLOCK", 300), ("QUERY_BLOCK", 60), ("BINS", 3), ("STEP", 100)):
        monkeypatch.setattr(top_k, name, value)
    rows = random_vectors()[:120] + random_vectors()[-16:]
    assert best_by_spark(spark, rows, k=3) == best_of(rows, 3, 10)


def test_top_k_of_large_numbers(spark):
    rows = [(0, [3e5, -4e5]), (1, [1e5, 2e5]), (2, [1e5 + 1, 2e5]), (3, [-3e6, 1.0]), (10, [1e7, 1e7])]
    assert best_by_spark(spark, rows) == best_of(rows, 5, 10)
    huge = best_by_spark(spark, [(0, [1e30, 1e30]), (1, [1e30, 1.0]), (2, [-1e30, 1.0]), (3, [1.0, 1.0])])
    assert [x[2] for x in huge] == [1, 3, 2] and huge[0][3] == top_k.LIMIT and huge[2][3] == -top_k.LIMIT


def test_top_k_of_nothing(spark):
    assert best_by_spark(spark, []) == []
    assert best_by_spark(spark, [(1, [1.0])]) == []
    assert best_by_spark(spark, [(10, [1.0])]) == []
