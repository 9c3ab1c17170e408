"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, block_extract, coordinate_negatives, decontaminate, group_join, hamming_join, lang_hierarchy, piece_codec, role_hmm, run_catch, suffix_dedup, token_cache, warc_legacy
from .storage import table


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """A vocabulary file: below ``spark.stateloom.tokenizers`` if that is set, else the installed package's."""
    folder = spark.conf.get("spark.stateloom.tokenizers", None)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op1_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.similar_components(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(spark, "piece_bpe_32k.model"), keep_ids=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_legacy.archive_pages(table(spark, sf_dir, "pages"), least_bytes=0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), threshold=400, keep_text=True)
    return found.withColumnRenamed("kept_text", "text").withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_hierarchy.identify(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_hmm.format_chats(table(spark, sf_dir, "conversations"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(spark, "byte_bpe_50k.json"), limit=512)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op10_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.nearest(table(spark, sf_dir, "embeddings"), every=20, top=20)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.select("vec_id", "embedding", coordinate_negatives.relabelled(F.col("vec_id"), F.col("label")).alias("label"))
    return coordinate_negatives.hard_negatives(vectors, every=50, positives=5, negatives=3, low=50, high=95)


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_join.near_duplicates(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", run_catch.planted(F.col("doc_id"), F.col("text")).alias("text"))
    return run_catch.run_digests(run_catch.periodic_runs(docs, exponent=4, length=6))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op1_ngram_links": op1_ngram_links,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language": op6_language,
    "op7_chat_format": op7_chat_format,
    "op8_token_counts": op8_token_counts,
    "op9_html_extraction": op9_html_extraction,
    "op10_additive_ann": op10_additive_ann,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_near_duplicates": op12_near_duplicates,
    "op13_periodic_runs": op13_periodic_runs,
}

_NGRAM_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
c AS (SELECT min(doc_id) AS class_id, len(first(shingles)) AS n, first(shingles) AS shingles FROM s WHERE len(shingles) > 0 GROUP BY list_sort(shingles)),
member AS (SELECT doc_id, len(shingles) AS n_shingles, min(doc_id) OVER (PARTITION BY list_sort(shingles)) AS class_id FROM s),
x AS (SELECT class_id, n, unnest(shingles) AS shingle FROM c),
joined AS (SELECT a.class_id AS a, b.class_id AS b, first(a.n) AS n, first(b.n) AS m, count(*) AS k FROM x a JOIN x b ON a.shingle = b.shingle AND a.class_id < b.class_id GROUP BY 1, 2),
links AS (SELECT a, b FROM joined WHERE 100 * k >= 80 * (n + m - k)),
reach AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a),
comp AS (SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n_shingles, CASE WHEN n_shingles = 0 THEN doc_id ELSE component_id END AS component_id, CASE WHEN n_shingles = 0 THEN doc_id ELSE m.class_id END AS class_id FROM member m LEFT JOIN comp USING (class_id)
"""

_LINKS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
c AS (SELECT min(doc_id) AS class_id, len(first(shingles)) AS n, first(shingles) AS shingles FROM s WHERE len(shingles) > 0 GROUP BY list_sort(shingles)),
member AS (SELECT doc_id, len(shingles) AS n_shingles, min(doc_id) OVER (PARTITION BY list_sort(shingles)) AS class_id FROM s),
x AS (SELECT class_id, n, unnest(shingles) AS shingle FROM c),
joined AS (SELECT a.class_id AS a, first(a.n) AS n, first(b.n) AS m, count(*) AS k FROM x a JOIN x b ON a.shingle = b.shingle AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id),
degree AS (SELECT a AS class_id, count(*) AS n_links FROM joined WHERE 100 * k >= 80 * (n + m - k) GROUP BY a)
SELECT doc_id, CASE WHEN n_shingles = 0 THEN doc_id ELSE m.class_id END AS class_id, coalesce(n_links, 0) AS n_links FROM member m LEFT JOIN degree USING (class_id)
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

_NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles FROM w),
member AS (SELECT doc_id, len(shingles) AS n, min(doc_id) OVER (PARTITION BY list_sort(shingles)) AS class_id, shingles FROM s),
x AS (SELECT class_id, n, unnest(shingles) AS shingle FROM member WHERE doc_id = class_id),
joined AS (SELECT a.class_id AS a, b.class_id AS b, first(a.n) AS n, first(b.n) AS m, count(*) AS k FROM x a JOIN x b ON a.shingle = b.shingle AND a.class_id < b.class_id GROUP BY 1, 2),
links AS (SELECT a, b FROM joined WHERE 100 * k >= 85 * (n + m - k)),
reach AS (SELECT class_id AS a, class_id AS b FROM member UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a),
comp AS (SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY 1),
named AS (SELECT doc_id, n, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id FROM member JOIN comp USING (class_id))
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM named
"""

_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 3
"""

SQL = {"op1_ngram_join": _NGRAM_SQL, "op1_ngram_links": _LINKS_SQL, "op4_warc": _WARC_SQL, "op11_hard_negatives": _NEGATIVES_SQL, "op12_near_duplicates": _NEAR_SQL}
