"""The registered queries of this subpackage: each operator over its whole table, with production parameters.

The tokenizer files are those of the installed package public_tokenizers; their paths are parameters of the operators.
"""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import (
    bpe, common, divergence, exact_dedup, jaccard, language, mixing, periodic_runs, quality, substring_dedup, token_counts, token_file, topk, vector_dedup,
)

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"
#: Fixed values of the token file: the id that ends a document, and the limit of a context in tokens.
END_ID, TOKEN_LIMIT = 2, 4096


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_BPE)
    docs = common.table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)).eqNullSafe(F.lit(2))
    model = common.stored(language.learn(docs, "text", "lang", ~held_out, path))
    out = language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), "text", model, path)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.bpe_encode_decode(docs, "text", public_tokenizers.path(WORD_BPE))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_join(common.table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_report(docs, "doc_id", "text", "source", mixing.cyclic_weights(3), most_epochs=3.0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.token_counts(docs, "text", public_tokenizers.path(PIECE_BPE))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", threshold=0.95)


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    manifest = token_file.write_token_files(docs, "doc_id", "text", public_tokenizers.path(WORD_BPE), END_ID, common.shared_dir(spark))
    back = token_file.read_token_files(manifest)
    return back.select(F.col("key").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs, "text", window=35, joined=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_scores(docs, "doc_id", "text").drop("text")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select(F.col("key").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("copies").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(common.table(spark, sf_dir, "documents"), "text", "lang", "source", least=30, most=50)


def with_planted_period(row: dict, words: list[bytes]) -> list[bytes]:
    """The words of a document; in one of ten they repeat with a period from some word on, as the contract of operator 13 says."""
    h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return (words[:a] + cycle * ((n - a) // p + 1))[:n]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = periodic_runs.collapse_runs(docs, "text", with_planted_period, ["doc_id"])
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = -F.col("best.n"), F.col("best.period")
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * -best.n div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES = {
    **{
        f.__name__: f
        for f in (
            op1_exact_top_k,
            op2_language_id,
            op3_bpe_encode_decode,
            op4_ngram_jaccard_join,
            op5_source_mix,
            op6_token_counts,
            op7_vector_near_dedup,
            op8_token_file,
            op9_substring_dedup,
            op10_quality_classifier,
            op11_exact_dedup,
            op12_source_divergence,
            op13_periodic_runs,
        )
    },
}

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_substring_dedup": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORDS}'), []) AS w FROM documents
        ), p AS (
            SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35
        ), h AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p
        ), r AS (
            SELECT h FROM h GROUP BY h HAVING count(*) > 1
        ), c AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM h WHERE h IN (SELECT h FROM r)
        ), a AS (
            SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
        ), k AS (
            SELECT a.doc_id, count(c.i) AS n_removed, string_agg(CASE WHEN c.i IS NULL THEN a.word END, ' ' ORDER BY a.i) AS kept
            FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.i = c.i GROUP BY a.doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op4_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORDS}'), []) AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), b AS (
            SELECT a.doc_id AS x, c.doc_id AS y, count(*) AS k FROM s a JOIN s c ON a.g = c.g AND a.doc_id <> c.doc_id GROUP BY a.doc_id, c.doc_id
        ), l AS (
            SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE k / CAST(p.n + q.n - k AS DOUBLE) >= 0.8
        ), t AS (
            SELECT doc_id, doc_id AS m FROM n UNION SELECT l.y, t.m FROM t JOIN l ON l.x = t.doc_id WHERE t.m < l.y
        ), h AS (
            SELECT doc_id, min(m) AS class_id FROM t GROUP BY doc_id
        ), e AS (
            SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x
        )
        SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
        FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id""",
    "op7_vector_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
        ), l AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95
        ), t AS (
            SELECT vec_id, vec_id AS m FROM v UNION SELECT l.y, t.m FROM t JOIN l ON l.x = t.vec_id WHERE t.m < l.y
        ), h AS (
            SELECT vec_id, min(m) AS component_id FROM t GROUP BY vec_id
        ), e AS (
            SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x
        )
        SELECT h.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, h.vec_id = component_id AS kept
        FROM h LEFT JOIN e ON e.vec_id = h.vec_id""",
    "op11_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
        ), k AS (
            SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS n, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS keep_id FROM d
        )
        SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k""",
    "op12_source_divergence": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{divergence.TERM_PATTERN}') AS w FROM documents
        ), t AS (
            SELECT r, lang, source, unnest(w) AS term FROM d
        ), k AS (
            SELECT lang, term FROM (SELECT DISTINCT lang, term, r FROM t) GROUP BY lang, term HAVING count(*) >= 30
        ), c AS (
            SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), v AS (
            SELECT g.lang, count(DISTINCT term) AS v FROM g LEFT JOIN k ON k.lang = g.lang GROUP BY g.lang
        ), x AS (
            SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), p AS (
            SELECT x.*, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY x.lang, x.source) + 5 * v) AS p FROM x JOIN v ON v.lang = x.lang
        ), l AS (
            SELECT x.lang, term, sum(n) AS n, any_value(v) AS v FROM x JOIN v ON v.lang = x.lang GROUP BY x.lang, term
        ), q AS (
            SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l
        ), f AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), e AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
        ), r AS (
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e
        )
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""",
}
