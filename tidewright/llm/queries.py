"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, byte_bpe, exact_dedup, ngram_join, pii, quality, sharding, substring_dedup, suffix_dedup, topk_search
from .runtime import fresh, work_dir


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, capacity=1024, closing_id=2)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(_docs(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(_docs(spark, sf_dir), size=13, digest=True)


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.col("vec_id").isNotNull() & topk_search.usable(F.col("embedding")))
    return topk_search.top_k(rows.select(F.col("vec_id").cast("long").alias("id"), topk_search.quantised(F.col("embedding")).alias("v")), F.col("id") % 50 == 0, k=5)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_docs(spark, sf_dir), n=4, similarity=Fraction(85, 100))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source delivers its documents to one of 16 feeds; every feed is an arrival. Nobody else reads this store, so replaced files go at once."""
    store = sharding.ShardStore(spark, f"{work_dir(spark)}/store-{uuid.uuid4().hex}")
    docs = _docs(spark, sf_dir)
    (feed,) = fresh(docs, "arrival")
    store.append(docs.withColumn(feed, F.pmod(F.xxhash64("source"), F.lit(16))), by=feed)
    store.compact(retain_seconds=0)
    return store.placed("doc_id", F.sha2("text", 256).alias("text_sha256"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(_docs(spark, sf_dir), size=50)
    return found.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_exact_dedup, op3_substring_dedup, op4_topk_search, op5_ngram_jaccard_join, op6_byte_bpe, op7_sharding, op8_suffix_array_dedup, op9_quality_classifier, op10_pii_sanitisation)
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_NORM}) AS text_sha256 FROM documents),
g AS (SELECT doc_id, text_sha256, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
    "op3_substring_dedup": r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM a),
g AS (SELECT doc_id, p, word, string_agg(word, ' ') OVER k AS k, count(*) OVER k AS n FROM w WINDOW k AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT k, min(doc_id) AS first FROM g WHERE n = 13 GROUP BY 1),
m AS (SELECT g.doc_id, p, word, CASE WHEN n = 13 AND first < g.doc_id THEN 1 ELSE 0 END AS hit FROM g LEFT JOIN f USING (k)),
c AS (SELECT doc_id, p, word, max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
s AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM c GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)
""",
    "op5_ngram_jaccard_join": rf"""
WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all({_NORM}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p, len(ws) AS size FROM a),
g AS (SELECT doc_id, p, size, string_agg(word, ' ') OVER k AS k, count(*) OVER k AS n FROM w WINDOW k AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, k FROM g WHERE n = 4 OR (size < 4 AND p = 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
j AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM j JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * common >= 85 * (ca.n + cb.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT doc_id, min(reached) AS least FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
""",
    "op4_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
 FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
}
