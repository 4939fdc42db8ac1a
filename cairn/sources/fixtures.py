"""Views of the driver's tables in the shapes that storage metadata has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def epoch_s(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return (F.unix_date(F.to_date(ts)) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: path, size in bytes, digest of the content."""
    f = t(spark, d, "documents")
    return f.select("doc_id", F.concat_ws("/", F.lit(""), "lang", "source", "doc_id").alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"), "text")


FILES = "files AS (SELECT doc_id, '/' || lang || '/' || source || '/' || doc_id AS path, octet_length(encode(text))::BIGINT AS size, sha256(text) AS digest, text FROM documents)"


def io_ops(spark: SparkSession, d: str) -> DataFrame:
    """Events as an I/O log: seq, t (seconds), ns, op, latency_us, bytes, block."""
    e = t(spark, d, "events")
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "click"), "read").when(kind == "purchase", "write").when(kind == "signup", "create").otherwise("sync")
    return e.select(
        F.col("event_id").alias("seq"), epoch_s("ts").alias("t"), F.col("user_id").alias("ns"), op.alias("op"),
        F.floor(F.col("value") * 100).alias("latency_us"), F.floor(F.col("value") * 1024).alias("bytes"), F.get_json_object("props", "$.k").cast("long").alias("block"),
    )


IO_OPS = """io_ops AS (SELECT event_id AS seq, epoch(date_trunc('second', ts))::BIGINT AS t, user_id AS ns,
  CASE WHEN event_type IN ('view', 'click') THEN 'read' WHEN event_type = 'purchase' THEN 'write' WHEN event_type = 'signup' THEN 'create' ELSE 'sync' END AS op,
  floor(value * 100)::BIGINT AS latency_us, floor(value * 1024)::BIGINT AS bytes, (props::JSON->>'$.k')::BIGINT AS block FROM events)"""


def extents(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems as extents: file, logical, physical, length."""
    x = t(spark, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 64).cast("long").alias("logical"), (F.col("l_partkey") * 64 + F.col("l_linenumber")).alias("physical"), F.col("l_quantity").cast("long").alias("length"))


EXTENTS = "extents AS (SELECT l_orderkey AS file, (l_linenumber * 64)::BIGINT AS logical, l_partkey * 64 + l_linenumber AS physical, trunc(l_quantity)::BIGINT AS length FROM lineitem)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems by supplier as log segments: segment, total, live, age_s (to 2000), cycles."""
    x = t(spark, d, "lineitem")
    b = F.col("l_quantity").cast("long") * 4096
    return x.groupBy(F.col("l_suppkey").alias("segment")).agg(F.sum(b).alias("total"), F.sum(F.when(F.col("l_returnflag") != "R", b).otherwise(0)).alias("live"), (F.lit(946684800) - F.max(epoch_s("l_shipdate"))).alias("age_s"), F.count("*").alias("cycles"))


SEGMENTS = """segments AS (SELECT l_suppkey AS segment, sum(trunc(l_quantity)::BIGINT * 4096)::BIGINT AS total,
  sum(CASE WHEN l_returnflag <> 'R' THEN trunc(l_quantity)::BIGINT * 4096 ELSE 0 END)::BIGINT AS live,
  946684800 - max(epoch(date_trunc('second', l_shipdate))::BIGINT) AS age_s, count(*) AS cycles FROM lineitem GROUP BY 1)"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Orders as snapshots: id, at (seconds)."""
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), epoch_s("o_orderdate").alias("at"))


SNAPSHOTS = """snapshots AS (SELECT o_orderkey AS id, epoch(date_trunc('second', o_orderdate))::BIGINT AS "at" FROM orders)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as versions of paths: path, pos (append order), ts, content."""
    return t(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("pos"), epoch_s("o_orderdate").alias("ts"), F.round(F.col("o_totalprice") * 100).cast("long").alias("content"))


VERSIONS = "versions AS (SELECT o_custkey AS path, o_orderkey AS pos, epoch(date_trunc('second', o_orderdate))::BIGINT AS ts, round(o_totalprice * 100)::BIGINT AS content FROM orders)"


def refs(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems as reference events: hash, delta, and a total order."""
    x = t(spark, d, "lineitem")
    return x.select(F.col("l_partkey").alias("hash"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).cast("long").alias("delta"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("ord"))


REFS = "refs AS (SELECT l_partkey AS hash, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END::BIGINT AS delta, (l_shipdate, l_orderkey, l_linenumber) AS ord FROM lineitem)"


def devices(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as pool devices: device, capacity, used, band (0 healthy .. 3 failing), leaving."""
    used = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("used"))
    s = t(spark, d, "supplier").join(used, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select(F.col("s_suppkey").alias("device"), (F.floor(F.abs("s_acctbal")) + 20000).alias("capacity"), F.coalesce("used", F.lit(0)).cast("long").alias("used"), (F.col("s_nationkey") % 4).cast("long").alias("band"), (F.col("s_suppkey") % 10 == 0).alias("leaving"))


DEVICES = """devices AS (SELECT s_suppkey AS device, floor(abs(s_acctbal))::BIGINT + 20000 AS capacity, coalesce(used, 0)::BIGINT AS used, (s_nationkey % 4)::BIGINT AS band, s_suppkey % 10 = 0 AS leaving
  FROM supplier LEFT JOIN (SELECT l_suppkey, sum(trunc(l_quantity)::BIGINT) AS used FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey)"""


def free_runs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select((F.col("p_partkey") * 100).alias("start"), F.col("p_size").cast("long").alias("len"))


FREE_RUNS = "free_runs AS (SELECT p_partkey * 100 AS start, p_size::BIGINT AS len FROM part)"
