"""The corpus pipeline: language ID, exact dedup, near dedup, mixing to source weights, packing into bins.

Each stage reads all its predecessor kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import exact_dedup, langid, mixing, packing, simhash
from cairn.llm.common import delete, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without a letter (`und`) go."""
    return langid.keep_known(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.drop_duplicates(docs, keep="largest").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    Near are fingerprints within three bits, and texts whose five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return simhash.drop_near_duplicates(docs, width=3, distance=3, set_width=5, similarity=(4, 5)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every document's words; repeats of a document share no bin, nor do documents of one source."""
    copies = F.sha2(F.coalesce("text", F.lit("")), 256)
    return packing.pack_documents(docs, size=mixing.word_count(F.col("text")), source=F.col("source"), cluster=copies, capacity=2048)


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing to weights", mix), ("best-fit packing", pack)]

#: Language ID, SimHash and packing are not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written to the shared folder, read again as the next one's input, and then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name.split()[0].lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
