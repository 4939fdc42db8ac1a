"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import exact_dedup, langid, licenses, mixing, packing, simhash, token_count, topk, toxicity, warc
from cairn.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
p AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS weights
  FROM w),
l AS (SELECT capped AS lc, total AS lt, weights AS lw FROM p WHERE (total - capped)::DOUBLE * weight / weights <= cap ORDER BY capped, weights LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN lc IS NULL OR (lt - lc)::DOUBLE * weight / lw >= cap THEN cap::DOUBLE ELSE (lt - lc)::DOUBLE * weight / lw END AS target
  FROM p LEFT JOIN l ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS reps FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
c AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM g),
x AS (
  SELECT c.*, b.source_size, b.target, b.reps, b.target - b.reps * b.source_size AS budget
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source),
y AS (
  SELECT *, CASE WHEN upto <= budget THEN 1
                 WHEN upto - words <= budget AND upto - budget < budget - (upto - words) THEN 1 ELSE 0 END AS more
  FROM x)
SELECT d.doc_id, d.size, y.source_size, y.target, (y.reps + y.more) * d.size AS taken
FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source AND d.h = y.h
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, ''))::BIGINT AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, ''))::BIGINT AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = token_count.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary, limit=4096)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_index(table(spark, sf_dir, "pages"), min_revisit=1000)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM q
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cutoff=0.7)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), width=3, distance=3)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 words; no bin holds two documents of one source or two copies of one text."""
    docs = table(spark, sf_dir, "documents")
    copies = F.sha2(F.coalesce("text", F.lit("")), 256)
    return packing.pack_documents(docs, size=mixing.word_count(F.col("text")), source=F.col("source"), cluster=copies, capacity=2048)


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_language_id": op3_language_id,
        "op4_token_counts": op4_token_counts,
        "op5_licenses": op5_licenses,
        "op6_warc": op6_warc,
        "op7_toxicity": op7_toxicity,
        "op8_topk": op8_topk,
        "op9_simhash": op9_simhash,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op5_licenses": licenses.oracle_sql(), "op6_warc": OP6_SQL, "op8_topk": OP8_SQL}
