"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import (
    bm25, collocations, fertility, langid, lexical, media, packing, piece_bpe, quality, sharding, simhash, substring, warc,
)
from stowage.llm.common import crc32_mod, table

SHARD_BYTES = 1 << 20


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), "doc_id", "text", SHARD_BYTES)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", size=4, within=4)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.texts_as_media(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_words(table(spark, sf_dir, "documents"), "doc_id", "text", length=13)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 3) == 1
    model = langid.fit(docs.filter(~held_out), "doc_id", "text", "lang")
    return langid.predict(docs, model, "doc_id", "text").select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), "page_id", "url", "html", least=1000)


def op8_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.top_k(docs, docs.filter("doc_id % 20 = 0"), "doc_id", "text", k=10)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(
        table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model")
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc32_mod("doc_id", 4) == 2
    weights = quality.fit(
        docs.select("doc_id", "text").filter(~held_out), labels.filter(~held_out), "doc_id", "text", "quality"
    )
    scored = quality.score(docs, weights, "doc_id", "text")
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical.ranked(docs, items, "doc_id", "text", "item_id", "text", k=10)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, ranks = (public_tokenizers.path(name) for name in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
    return fertility.judge(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", pieces, ranks)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(table(spark, sf_dir, "documents"), "text", "lang", least=100, most=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_extendible_sharding,
        op2_simhash_near_dedup,
        op3_best_fit_packing,
        op4_media_columns,
        op5_substring_dedup,
        op6_language_id,
        op7_warc,
        op8_bm25_top_k,
        op9_sentencepiece,
        op10_quality_classifier,
        op11_ranked_lexical_search,
        op12_quality_rules,
        op13_phrase_collocations,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_extendible_sharding": f"""
        WITH d AS (SELECT row_number() OVER () AS i, doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
                          ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
             e AS (SELECT d.*, t.depth, h >> (60 - t.depth) AS prefix FROM d, generate_series(0, 60) AS t(depth)),
             b AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM e GROUP BY ALL),
             f AS (SELECT e.*, shard_bytes, shard_rows FROM e JOIN b USING (depth, prefix) WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1)
        SELECT doc_id, n_bytes::BIGINT AS n_bytes, depth::INTEGER AS shard_depth,
               CASE WHEN depth = 0 THEN '' ELSE right(bin(prefix + (1::BIGINT << 61)), depth::INTEGER) END AS shard_prefix,
               shard_bytes::BIGINT AS shard_bytes, shard_rows::BIGINT AS shard_rows, 0::BIGINT AS shard_part
        FROM f QUALIFY row_number() OVER (PARTITION BY i ORDER BY depth) = 1
    """,
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
             s AS (SELECT doc_id, i, array_to_string(a[i : i + 12], ' ') AS w FROM (SELECT doc_id, a, unnest(generate_series(1, len(a) - 12)) AS i FROM d WHERE len(a) >= 13)),
             f AS (SELECT w, min(doc_id) AS first FROM s GROUP BY w HAVING count(DISTINCT doc_id) > 1),
             g AS (SELECT DISTINCT s.doc_id, s.i + k AS pos FROM s JOIN f ON f.w = s.w AND s.doc_id > f.first, generate_series(0, 12) AS t(k)),
             k AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept FROM (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM d) AS p ANTI JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id)
        SELECT d.doc_id, len(a)::BIGINT AS n_words, (len(a) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
             q AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS last FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
        FROM q
    """,
    "op8_bm25_top_k": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents WHERE doc_id IS NOT NULL),
             n AS (SELECT count(*) AS total, sum(len(a))::DOUBLE / count(*) AS mean FROM d),
             t AS (SELECT doc_id, word, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(a) AS word, len(a) AS dl FROM d) GROUP BY doc_id, word),
             i AS (SELECT word, ln(1 + (any_value(total) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM t, n GROUP BY word),
             s AS (SELECT q.doc_id AS query_id, t.doc_id, sum(round(1e6::DOUBLE * (idf * t.tf * (1.2::DOUBLE + 1) / (t.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * t.dl / mean))))::BIGINT)::BIGINT AS score
                   FROM t q JOIN t ON t.word = q.word JOIN i ON i.word = q.word, n WHERE q.doc_id % 20 = 0 GROUP BY 1, 2),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op11_ranked_lexical_search": r"""
        WITH x AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS a FROM documents),
             g AS (SELECT count(*)::BIGINT AS big_n, sum(len(a))::BIGINT AS big_l FROM x WHERE len(a) > 0),
             t AS (SELECT i, term, any_value(doc_id) AS doc_id, any_value(n) AS n, count(*) AS tf FROM (SELECT i, doc_id, len(a) AS n, unnest(a) AS term FROM x) GROUP BY i, term),
             w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, g GROUP BY term),
             q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
             s AS (SELECT item_id, i, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l)))))::BIGINT AS score
                   FROM q JOIN w ON w.term = q.term JOIN t ON t.term = q.term, g GROUP BY item_id, i),
             r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op13_phrase_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             a AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS a FROM p),
             w AS (SELECT lang, k, array_to_string(a[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, a, k, unnest(generate_series(1, len(a) - k + 1)) AS i FROM a, generate_series(1, 5) AS t(k) WHERE len(a) >= k)),
             n AS (SELECT lang, count(*) AS n FROM w WHERE k = 1 GROUP BY lang),
             f AS (SELECT lang, any_value(k) AS k, phrase, count(*) AS f FROM w GROUP BY lang, phrase HAVING count(*) >= 100),
             c AS (SELECT f.lang, f.phrase, f.f AS a, j, string_split(f.phrase, ' ') AS v FROM f, generate_series(1, 4) AS t(j) WHERE f.k > 1 AND j < f.k),
             s AS (SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
                   FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(v[1 : j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(v[j + 1 : len(v)], ' ') JOIN n ON n.lang = c.lang),
             b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
             o AS (SELECT lang, array_to_string(v[i : i + m - 1], ' ') AS phrase, max(f) AS f FROM (SELECT lang, string_split(phrase, ' ') AS v, f, m, unnest(generate_series(1, k - m + 1)) AS i FROM f, generate_series(2, 4) AS t(m) WHERE m < k) GROUP BY 1, 2),
             e AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100 * o.f < 100 * b.a),
             z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score FROM z WHERE rank <= 2000
    """,
}
