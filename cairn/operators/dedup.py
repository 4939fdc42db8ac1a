"""Dedup statistics and reference counts over content digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.registry import query


@query("""
WITH f AS (SELECT sha256(text) AS h, octet_length(encode(text)) AS n FROM documents),
g AS (SELECT h, count(*) AS c, max(n) AS n FROM f GROUP BY h)
SELECT count(*)::BIGINT AS unique_objects, sum(c - 1)::BIGINT AS hits, sum(c * n)::BIGINT AS logical_bytes,
       sum(n)::BIGINT AS stored_bytes, round(sum(c * n) / sum(n), 6) AS ratio FROM g
""")
def a2_dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    g = spark.read.parquet(f"{d}/documents.parquet").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("c"), F.max(F.octet_length("text")).alias("n"))
    logical, stored = F.sum(F.col("c") * F.col("n")), F.sum("n")
    return g.agg(F.count("*").alias("unique_objects"), F.sum(F.col("c") - 1).alias("hits"), logical.alias("logical_bytes"), stored.alias("stored_bytes"), F.round(logical / stored, 6).alias("ratio"))
