"""Registered queries of the operators for training data, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import bond, bpe, filteraudit, innerproduct, jaccard, language, licenses, mincut, mixing, piecewise, polytope, quality, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of the public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


#: Rules of the url query: host, path, verdict.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op2_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 20 largest inner products of whole-number vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return innerproduct.search(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate 20 nearest vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return polytope.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return mincut.extract(pages, weights=mincut.fit(pages))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.fit(docs))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose word shingles are similar."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and the text they decode to, as digests."""
    path = vocabulary_path()
    out = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return out.select("doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are drawn for the mix."""
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), most_passes=2.0)
    return out.select("doc_id", "source", "tokens", "mix_weight", "mix_pass", "mix_order")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from three of four."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out("doc_id")).select("text", "lang"))
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "lang_rejected")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail chances of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(quality.graded(docs, table(spark, sf_dir, "labels")))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "p_clean", "p_good")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by language."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and the text they decode to, as digests."""
    return piecewise.digests(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 100, some labels being noise."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    noisy = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return bond.mine(noisy, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_top_inner_products, op3_jaccard_join, op4_cross_polytope, op5_main_text, op6_license_scan, op7_bpe,
        op8_source_mix, op9_language_id, op10_quality, op11_filter_audit, op12_sentencepiece, op13_hard_negatives,
    )
}

_RULES = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in RULES)

SQL: dict[str, str] = {
    "op1_url_filter": f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, row_number() OVER () AS r,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules AS ({_RULES}), fits AS (
  SELECT s.r, h || p AS rule, v, row_number() OVER (PARTITION BY s.r ORDER BY length(h || p) DESC, h || p) AS n
  FROM split s JOIN rules ON (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.r = s.r AND f.n = 1
""",
    "op2_top_inner_products": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
""",
    "op11_filter_audit": r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), failed AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM words
), judged AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM failed LEFT JOIN judged USING (doc_id) GROUP BY part, mask
), letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(c, b)), orders AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS o, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31
), steps AS (
  SELECT o, CAST(k AS INTEGER) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS earlier FROM orders, range(1, 6) AS r(k)
)
SELECT part, o AS filter_order, step,
       CAST(sum(CASE WHEN mask & bit = 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM cells, steps GROUP BY part, o, step, bit
""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), anchors AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) AS k FROM v WHERE vec_id % 100 = 0) WHERE k = 1
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM anchors a JOIN v c ON a.vec_id <> c.vec_id OR a.label <> c.label
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same
), r AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY s.score DESC, s.vec_id) AS n
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
  WHERE place <= 5
)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE n <= 10
""",
}
