"""Queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language_id, packing, phrases, pii, piece_bpe, prefix_trie, quality, relative_lz, rp_forest, setsketch, top_k, toxicity
from .common import remainder, table


def tokenizer_file(spark: SparkSession, name: str) -> str:
    """Path of a public tokenizer's file; spark.tallyspark.tokenizers may name another folder."""
    at = spark.conf.get("spark.tallyspark.tokenizers", None)
    if at:
        return f"{at}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_rp_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file(spark, "piece_bpe_32k.model"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.predict_language(table(spark, sf_dir, "documents"), may_learn=remainder("doc_id", 3) != 1)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), may_learn=remainder("doc_id", 4) != 2)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(spark, "word_bpe_49k.json"))


def op9_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.remove_repeats(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), may_learn=remainder("doc_id", 5) != 0)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    trie = prefix_trie.prefix_trie(*prefix_trie.with_shared_beginnings(turns))
    return trie.drop("first_place", "last_place")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rp_forest_dedup": op1_rp_forest_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pii": op6_pii,
    "op7_setsketch_dedup": op7_setsketch_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_relative_lz_dedup": op9_relative_lz_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_phrases": op12_phrases,
    "op13_top_k": op13_top_k,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op7_setsketch_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 2 THEN [words[1]]
                   ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w
        ), n AS (
            SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
        ), shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
        ), link AS (
            SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.size + nb.size - common)
        ), two_way AS (
            SELECT a, b FROM link UNION SELECT b, a FROM link
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, t.b FROM reach r JOIN two_way t ON t.a = r.other
        )
        SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
        FROM documents d JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.size
    """,
    "op9_relative_lz_dedup": """
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words FROM documents
        ), win AS (
            SELECT doc_id, i AS start, md5(array_to_string(words[i : i + 34], ' ')) AS h
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)
        ), twice AS (
            SELECT h FROM win GROUP BY h HAVING count(*) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(start, start + 35)) AS pos FROM win SEMI JOIN twice USING (h)
        ), word AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
        )
        SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept k USING (doc_id)
    """,
    "op1_rp_forest_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), link AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
            WHERE list_cosine_similarity(x.e, y.e) >= 0.98
        ), reach(vec_id, other) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other
        ), n AS (
            SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a
        )
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, min(r.other) AS component_id, e.vec_id = min(r.other) AS kept
        FROM embeddings e JOIN reach r USING (vec_id) LEFT JOIN n USING (vec_id) GROUP BY e.vec_id, n.n_links
    """,
    "op11_prefix_trie": """
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
                   sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
            FROM conversations WHERE conv_id IS NOT NULL
        ), crc AS (
            SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                   lambda x, y: list_reduce(list_prepend(xor(x, y), CAST(range(8) AS BIGINT[])), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM t)
        ), rebuilt AS (
            SELECT c.conv_id, 0 AS part, place, key, words FROM crc c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND place <= h
            UNION ALL SELECT conv_id, 1, place, key, words FROM t JOIN crc USING (conv_id) WHERE place > h
        ), r AS (
            SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM rebuilt
        ), p AS (
            SELECT conv_id, depth, words, sha256(string_agg(key, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM r
            UNION ALL SELECT conv_id, 0, 0, '' FROM crc
        ), q AS (
            SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p
        ), n AS (
            SELECT node, depth, any_value(above) AS above, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM q GROUP BY node, depth
        ), k AS (
            SELECT above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above
        ), m AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)
        ), sub AS (
            SELECT up.node, sum((m.n_children = 0)::INT) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved
            FROM m JOIN p down ON down.node = m.node AND down.conv_id = m.conv_id JOIN p up ON up.conv_id = down.conv_id AND up.depth <= down.depth GROUP BY up.node
        )
        SELECT m.conv_id, m.depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(sub.n_leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, m.ends_sha256
        FROM m JOIN sub USING (node) LEFT JOIN n a ON a.node = m.above
    """,
    "op12_phrases": """
        WITH w AS (
            SELECT lang, piece, list_filter(string_split(replace(text, '\x09', ' '), ' '), lambda x: x <> '') AS words FROM (
                SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, text FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS text FROM documents))
        ), g AS (
            SELECT lang, d, array_to_string(words[i : i + d - 1], ' ') AS phrase, words[i : i + d - 1] AS ws
            FROM (SELECT lang, words, d, unnest(range(1, len(words) - d + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(d))
        ), f AS (
            SELECT lang, d, phrase, any_value(ws) AS ws, count(*) AS a FROM g GROUP BY lang, d, phrase
        ), n AS (
            SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE d = 1 GROUP BY lang
        ), c AS (
            SELECT * FROM f WHERE d > 1 AND a >= 10
        ), cuts AS (
            SELECT lang, d, phrase, a, k, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 :], ' ') AS rest FROM c, (VALUES (1), (2)) v(k) WHERE k < d
        ), s AS (
            SELECT x.*, h.a AS l, t.a AS r, CAST(CAST(1000000 AS HUGEINT) * x.a * x.a // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
            FROM cuts x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f t ON t.lang = x.lang AND t.phrase = x.rest
        ), best AS (
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), longer AS (
            SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) AS part FROM c WHERE d = 3) GROUP BY lang, part
        ), kept AS (
            SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.part = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op13_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e, row_number() OVER () AS row FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
