"""Aggregations: refcounts, liveness, histograms, entropy, sharing, quorum, parity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.plans.registry import query
from cairn.sources import fixtures as fx
from cairn.sources.fixtures import t


def clamped_refcount(events: DataFrame, key: str, delta: str, order: str) -> DataFrame:
    """Refcounts that never fall below zero at any step: total - min(0, least prefix sum). A window per key, no fold."""
    run = F.sum(delta).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_s", run).groupBy(key).agg((F.sum(delta) - F.least(F.lit(0), F.min("_s"))).alias("refcount"))


@query(f"""WITH {fx.REFS}, r AS (SELECT hash, delta, sum(delta) OVER (PARTITION BY hash ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s FROM refs)
SELECT hash, (sum(delta) - least(0, min(s)))::BIGINT AS refcount FROM r GROUP BY hash""")
def a3_refcount(spark: SparkSession, d: str) -> DataFrame:
    return clamped_refcount(fx.refs(spark, d), "hash", "delta", "ord")


@query(f"WITH {fx.SEGMENTS} SELECT segment, total, live, CASE WHEN total > 0 THEN round(live / total, 9) ELSE 0 END AS live_fraction FROM segments")
def a4_segment_liveness(spark: SparkSession, d: str) -> DataFrame:
    return fx.segments(spark, d).select("segment", "total", "live", F.when(F.col("total") > 0, F.round(F.col("live") / F.col("total"), 9)).otherwise(0.0).alias("live_fraction"))


#: log2(1 + j/16) in 16.16 fixed point.
LOG2_FRACTIONS = [0, 5732, 11134, 16241, 21087, 25706, 30102, 34303, 38328, 42186, 45890, 49458, 52896, 56211, 59417, 62516]


def log2_q16(x: Column) -> Column:
    """log2 of a positive integer in 16.16: the bit length and a 16-step fraction."""
    f = F.length(F.bin(x)) - 1
    base = F.pow(F.lit(2.0), f).cast("long")
    j = F.least(F.lit(15), F.floor((x - base) * 16 / base)).cast("int")
    return F.shiftleft(f.cast("long"), 16) + F.element_at(F.array(*map(F.lit, LOG2_FRACTIONS)), j + 1)


def byte_histogram(objects: DataFrame, key: str, data: Column) -> DataFrame:
    """(key, byte, n, len) for every byte value that occurs. Bytes are counted inside the row, in time linear in its length."""

    @F.pandas_udf("array<long>")
    def counts(s: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.frombuffer(b, np.uint8), minlength=256) for b in s])

    rows = objects.withColumn("_len", F.octet_length(data).cast("long")).filter("_len > 0")
    rows = rows.select(key, "_len", F.posexplode(counts(data)).alias("_byte", "_n")).filter("_n > 0")
    return rows.groupBy(key, "_len", F.lpad(F.hex("_byte"), 2, "0").alias("byte")).agg(F.sum("_n").alias("n"))


def entropy_q32(hist: DataFrame, key: str) -> DataFrame:
    """Bits a byte in 32.32 fixed point, at most 8."""
    p = F.expr("(n << 32) div _len").cast("decimal(20,0)")
    term = F.floor(p * (log2_q16(F.col("_len")) - log2_q16(F.col("n"))).cast("decimal(18,0)") / 65536).cast("long")
    return hist.groupBy(key).agg(F.least(F.sum(term), F.lit(8 << 32)).alias("entropy"))


@query("""WITH b AS (SELECT doc_id, octet_length(encode(text)) AS len, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents),
h AS (SELECT doc_id, byte, count(*) AS n, max(len) AS len FROM b GROUP BY 1, 2),
f(t) AS (SELECT [0, 5732, 11134, 16241, 21087, 25706, 30102, 34303, 38328, 42186, 45890, 49458, 52896, 56211, 59417, 62516]),
l AS (SELECT doc_id, n, len, (length(bin(n)) - 1) AS fn, (length(bin(len)) - 1) AS fl FROM h),
q AS (SELECT doc_id, n, len, fl * 65536 + t[least(15, (len - (1::BIGINT << fl)) * 16 // (1::BIGINT << fl)) + 1] - (fn * 65536 + t[least(15, (n - (1::BIGINT << fn)) * 16 // (1::BIGINT << fn)) + 1]) AS neg FROM l, f)
SELECT doc_id, least(sum(((n::HUGEINT * 4294967296 // len) * neg) // 65536), 34359738368)::BIGINT AS entropy FROM q GROUP BY doc_id""")
def a5_byte_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Byte entropy of every object that has a byte."""
    return entropy_q32(byte_histogram(t(spark, d, "documents"), "doc_id", F.col("text").cast("binary")), "doc_id")


#: The first twelve latency bounds in microseconds; each later decade is the one before times 1000, the last bound is an hour-scale cap.
_DECADES = [1, 2, 4, 7, 12, 21, 38, 68, 120, 210, 380, 680]
BOUNDS = [b * 1000**k for k in range(4) for b in _DECADES] + [2_160_000_000_000]


def histogram(values: DataFrame, value: str) -> DataFrame:
    """(i, bound, cumulative) for every bound. Values are put into buckets by an expression and counted; 49 rows are accumulated, not the input."""
    at = F.array_position(F.transform(F.array(*map(F.lit, BOUNDS)), lambda b: b >= F.col(value)), True) - 1
    counts = values.select(F.when(at >= 0, at).otherwise(len(BOUNDS)).cast("long").alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    bounds = values.sparkSession.createDataFrame(list(enumerate(BOUNDS)), "i long, bound long")
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return F.broadcast(bounds).join(counts, "i", "left").select("i", "bound", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("cumulative"))


_BOUNDS = "bounds AS (SELECT (k * 12 + i)::BIGINT AS i, (b * pow(1000, k))::BIGINT AS bound FROM range(4) r(k), (VALUES " + ", ".join(f"({i}, {b})" for i, b in enumerate(_DECADES)) + ") v(i, b) UNION ALL SELECT 48, 2160000000000)"
_HIST = f"{fx.IO_OPS}, {_BOUNDS}, hist AS (SELECT i, bound, (SELECT count(*) FROM io_ops WHERE latency_us <= bound) AS cumulative FROM bounds)"


@query(f"WITH {_HIST} SELECT i, bound, cumulative FROM hist")
def a6_latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return histogram(fx.io_ops(spark, d), "latency_us")


def histogram_quantiles(hist: DataFrame, qs: list[float]) -> DataFrame:
    """Linear inside the bucket from the bound before, truncated; beyond the last bound, that bound. Over the 49 histogram rows."""
    total = hist.agg(F.max("cumulative").alias("total"))
    w = Window.orderBy("i")
    h = hist.select("i", "bound", "cumulative", F.coalesce(F.lag("bound").over(w), F.lit(0)).alias("pb"), F.coalesce(F.lag("cumulative").over(w), F.lit(0)).alias("pc"))
    q = hist.sparkSession.createDataFrame([(x,) for x in qs], "q double")
    h = h.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(q)).withColumn("target", F.least(F.greatest("q", F.lit(0.0)), F.lit(1.0)) * F.col("total"))
    span = (F.col("cumulative") - F.col("pc")).cast("double")
    into = F.when(span > 0, F.least(F.greatest((F.col("target") - F.col("pc")) / span, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    v = F.col("pb") + (into * (F.col("bound") - F.col("pb"))).cast("long")
    best = h.groupBy("q").agg(F.min_by(v, F.when(F.col("cumulative") >= F.col("target"), F.col("i"))).alias("v"), F.max("bound").alias("last"))
    return best.select("q", F.coalesce("v", "last").alias("value_us"))


@query(f"""WITH {_HIST}, h AS (SELECT *, coalesce(lag(bound) OVER (ORDER BY i), 0) AS pb, coalesce(lag(cumulative) OVER (ORDER BY i), 0) AS pc FROM hist),
q(q) AS (VALUES (-1.0::DOUBLE), (0.5), (0.9), (0.99), (2.0)), g AS (SELECT q, least(greatest(q, 0), 1) * (SELECT count(*) FROM io_ops) AS target FROM q),
r AS (SELECT q, arg_min(pb + trunc(CASE WHEN cumulative > pc THEN least(greatest((target - pc) / (cumulative - pc), 0), 1) ELSE 0 END * (bound - pb))::BIGINT, i) AS value_us FROM g, h WHERE cumulative >= target GROUP BY q)
SELECT q, value_us FROM r""")
def a7_histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    return histogram_quantiles(histogram(fx.io_ops(spark, d), "latency_us"), [-1.0, 0.5, 0.9, 0.99, 2.0])


@query(f"WITH {fx.IO_OPS} SELECT op, sum(latency_us)::BIGINT // count(*) AS mean_us FROM io_ops GROUP BY op")
def a8_histogram_mean(spark: SparkSession, d: str) -> DataFrame:
    return fx.io_ops(spark, d).groupBy("op").agg(F.expr("sum(latency_us) div count(*)").alias("mean_us"))


@query(f"""WITH {fx.IO_OPS}, r AS (SELECT op, latency_us AS v, row_number() OVER (PARTITION BY op ORDER BY latency_us) AS n, count(*) OVER (PARTITION BY op) AS c FROM io_ops)
SELECT op, max(v) FILTER (n = greatest(1, ceil(c * 0.5)::BIGINT)) AS p50, max(v) FILTER (n = greatest(1, ceil(c * 0.99)::BIGINT)) AS p99 FROM r GROUP BY op""")
def a10_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    """percentile_disc counts distinct values before it sorts them, so a hot value costs one entry."""
    p = lambda x: F.expr(f"percentile_disc({x}) within group (order by latency_us)").cast("long")
    return fx.io_ops(spark, d).groupBy("op").agg(p(0.5).alias("p50"), p(0.99).alias("p99"))


@query(f"WITH {fx.FREE_RUNS} SELECT start % 700 AS device, count(*)::BIGINT AS runs, sum(len)::BIGINT AS total, max(len) AS largest, CASE WHEN count(*) <= 1 OR sum(len) = 0 THEN 0 ELSE round(1 - max(len) / sum(len), 9) END::DOUBLE AS fragmentation FROM free_runs GROUP BY 1")
def a11_fragmentation(spark: SparkSession, d: str) -> DataFrame:
    g = fx.free_runs(spark, d).groupBy((F.col("start") % 700).alias("device")).agg(F.count("*").alias("runs"), F.sum("len").alias("total"), F.max("len").alias("largest"))
    return g.withColumn("fragmentation", F.when((F.col("runs") <= 1) | (F.col("total") == 0), 0.0).otherwise(F.round(1 - F.col("largest") / F.col("total"), 9)))


@query(f"WITH {fx.DEVICES} SELECT device, CASE WHEN capacity = 0 THEN 0 ELSE round(1 - (capacity - used) / capacity, 9) END::DOUBLE AS used_fraction, capacity - used AS free_inodes FROM devices")
def a12_space_stats(spark: SparkSession, d: str) -> DataFrame:
    free = F.col("capacity") - F.col("used")
    return fx.devices(spark, d).select("device", F.when(F.col("capacity") == 0, 0.0).otherwise(F.round(1 - free / F.col("capacity"), 9)).alias("used_fraction"), free.alias("free_inodes"))


@query("""WITH c AS (SELECT p_brand AS g, p_size AS n FROM part), r AS (SELECT g, ln(row_number() OVER (PARTITION BY g ORDER BY n DESC)) AS x, ln(n) AS y FROM c WHERE n > 0)
SELECT g, round(CASE WHEN count(*) < 2 THEN 0.86 ELSE greatest(0, least(0.999, -regr_slope(y, x))) END, 6)::DOUBLE AS skew FROM r GROUP BY g""")
def a13_zipf_skew(spark: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n")))
    c = t(spark, d, "part").filter("p_size > 0").select(F.col("p_brand").alias("g"), F.col("p_size").alias("n")).select("g", F.ln(r).alias("x"), F.ln("n").alias("y"))
    fit = F.greatest(F.lit(0.0), F.least(F.lit(0.999), -F.regr_slope("y", "x")))
    return c.groupBy("g").agg(F.round(F.when(F.count("*") < 2, 0.86).otherwise(fit), 6).alias("skew"))


_LAYERS = "layers AS (SELECT p_type AS digest, max(p_size)::BIGINT * 1048576 AS bytes, count(*) AS refs FROM part GROUP BY 1)"


@query(f"WITH {_LAYERS} SELECT sum(bytes)::BIGINT AS materialized, sum(bytes * refs)::BIGINT AS logical, sum(bytes * (refs - 1))::BIGINT AS saved, CASE WHEN sum(bytes) = 0 THEN 10000 ELSE (sum(bytes * refs) * 10000 // sum(bytes))::BIGINT END AS bps FROM layers")
def a14_layer_sharing(spark: SparkSession, d: str) -> DataFrame:
    layers = t(spark, d, "part").groupBy("p_type").agg((F.max("p_size").cast("long") * (1 << 20)).alias("bytes"), F.count("*").alias("refs"))
    s = layers.agg(F.sum("bytes").alias("materialized"), F.sum(F.col("bytes") * F.col("refs")).alias("logical"), F.sum(F.col("bytes") * (F.col("refs") - 1)).alias("saved"))
    return s.withColumn("bps", F.when(F.col("materialized") == 0, 10000).otherwise(F.expr("logical * 10000 div materialized")))


@query("SELECT p_partkey AS n, (pow(2, ceil(log2(10 * p_partkey))))::BIGINT AS bits, round(pow(1 - exp(-7.0 * p_partkey / pow(2, ceil(log2(10 * p_partkey)))), 7), 9) AS fpp FROM part WHERE p_partkey > 0")
def a16_bloom_fpp(spark: SparkSession, d: str) -> DataFrame:
    """Filter size (ten bits an item, up to a power of two) and false-positive rate at seven hashes."""
    n = F.col("p_partkey")
    bits = F.pow(F.lit(2.0), F.ceil(F.log2(n * 10)))
    return t(spark, d, "part").filter("p_partkey > 0").select(n.alias("n"), bits.cast("long").alias("bits"), F.round(F.pow(1 - F.exp(n * -7.0 / bits), F.lit(7)), 9).alias("fpp"))


@query("""WITH log AS (SELECT o_orderkey % 50 AS grp, o_orderkey // 50 AS idx, CASE WHEN o_orderkey // 50 > 5 THEN 2 ELSE 1 END AS term FROM orders),
m AS (SELECT s_suppkey % 50 AS grp, s_suppkey AS peer, (s_suppkey * 7) % 40 AS match FROM supplier),
n AS (SELECT grp, count(*) + 1 AS size FROM m GROUP BY 1)
SELECT l.grp, max(l.idx) AS commit_index FROM log l JOIN n ON l.grp = n.grp WHERE term = 2 AND 1 + (SELECT count(*) FROM m WHERE m.grp = l.grp AND match >= l.idx) >= size // 2 + 1 GROUP BY l.grp""")
def a17_quorum_commit(spark: SparkSession, d: str) -> DataFrame:
    """The quorum's match index is an order statistic of the peers, so no index meets every peer: sort the matches, take the one a majority reaches."""
    o = F.col("o_orderkey")
    log = t(spark, d, "orders").select((o % 50).alias("grp"), F.floor(o / 50).alias("idx"), F.when(F.floor(o / 50) > 5, 2).otherwise(1).alias("term")).filter("term = 2")
    s = F.col("s_suppkey")
    peers = t(spark, d, "supplier").groupBy((s % 50).alias("grp")).agg(F.sort_array(F.collect_list((s * 7) % 40), asc=False).alias("m"))
    need = F.floor((F.size("m") + 1) / 2).cast("int")  # peers beside the leader
    peers = peers.select("grp", F.when(need == 0, F.lit((1 << 62))).otherwise(F.element_at("m", need)).alias("reached"))
    return log.join(peers, "grp").filter("idx <= reached").groupBy("grp").agg(F.max("idx").alias("commit_index"))


@query("""WITH b AS (SELECT l_orderkey // 4 AS stripe, l_orderkey % 4 AS dev, l_linenumber AS word, l_partkey * 7919 + l_suppkey AS v FROM lineitem),
p AS (SELECT stripe, word, bit_xor(v) AS parity, bit_xor(CASE WHEN dev <> 1 THEN v ELSE 0 END) AS others FROM b GROUP BY 1, 2)
SELECT stripe, word, parity, xor(parity, others) AS rebuilt_1 FROM p""")
def a19_xor_parity(spark: SparkSession, d: str) -> DataFrame:
    """Parity words of a stripe, and device 1 rebuilt from parity and survivors."""
    x = t(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("stripe"), (F.col("l_orderkey") % 4).alias("dev"), F.col("l_linenumber").alias("word"), (F.col("l_partkey") * 7919 + F.col("l_suppkey")).alias("v"))
    p = x.groupBy("stripe", "word").agg(F.bit_xor("v").alias("parity"), F.bit_xor(F.when(F.col("dev") != 1, F.col("v")).otherwise(0)).alias("others"))
    return p.select("stripe", "word", "parity", F.col("parity").bitwiseXOR(F.col("others")).alias("rebuilt_1"))


@query("""WITH c AS (SELECT p_brand AS domain, md5(p_name || p_partkey) AS h, p_size AS len FROM part WHERE p_size % 3 <> 0), r AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY h) - 1) // 4 AS g FROM c)
SELECT domain, g, max(len)::BIGINT AS shard_len, (max(len) * 4 - sum(len))::BIGINT AS padding FROM r GROUP BY 1, 2 HAVING count(*) = 4""")
def a22_ec_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Live chunks in groups of four in hash order within their domain; a group that is not full waits."""
    c = t(spark, d, "part").filter("p_size % 3 <> 0").select(F.col("p_brand").alias("domain"), F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("h"), F.col("p_size").cast("long").alias("len"))
    g = F.floor((F.row_number().over(Window.partitionBy("domain").orderBy("h")) - 1) / 4)
    return c.withColumn("g", g).groupBy("domain", "g").agg(F.max("len").alias("shard_len"), (F.max("len") * 4 - F.sum("len")).alias("padding"), F.count("*").alias("n")).filter("n = 4").drop("n")


@query(f"WITH {fx.IO_OPS} SELECT ns, count(*) FILTER (op = 'read')::BIGINT AS reads, count(*) FILTER (op = 'write')::BIGINT AS writes, sum(bytes)::BIGINT AS bytes, count(*) FILTER (block % 5 < 2)::BIGINT AS hits, count(*) FILTER (block % 5 >= 2)::BIGINT AS misses FROM io_ops GROUP BY ns")
def a24_op_counters(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return fx.io_ops(spark, d).groupBy("ns").agg(F.count_if(c("op") == "read").alias("reads"), F.count_if(c("op") == "write").alias("writes"), F.sum("bytes").alias("bytes"), F.count_if(c("block") % 5 < 2).alias("hits"), F.count_if(c("block") % 5 >= 2).alias("misses"))


@query(f"WITH {fx.IO_OPS} SELECT op AS class, count(*) FILTER (latency_us < 5000)::BIGINT AS admitted, count(*) FILTER (latency_us >= 5000 AND op <> 'read')::BIGINT AS delayed, count(*) FILTER (latency_us >= 5000 AND op = 'read')::BIGINT AS overruns FROM io_ops GROUP BY op")
def a25_policy_counters(spark: SparkSession, d: str) -> DataFrame:
    late, read = F.col("latency_us") >= 5000, F.col("op") == "read"
    return fx.io_ops(spark, d).groupBy(F.col("op").alias("class")).agg(F.count_if(~late).alias("admitted"), F.count_if(late & ~read).alias("delayed"), F.count_if(late & read).alias("overruns"))


@query(f"""WITH {fx.SNAPSHOTS} SELECT coalesce(max(id) FILTER ("at" < 800000000), 0) AS early, coalesce(max(id) FILTER ("at" < 0), 0) AS none FROM snapshots""")
def a26_max_barrier(spark: SparkSession, d: str) -> DataFrame:
    g = lambda cut: F.coalesce(F.max(F.when(F.col("at") < cut, F.col("id"))), F.lit(0))
    return fx.snapshots(spark, d).agg(g(800000000).alias("early"), g(0).alias("none"))


@query("""SELECT 'orders_have_customers' AS name, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 AS passed
UNION ALL SELECT 'lineitems_have_orders', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0
UNION ALL SELECT 'part_keys_unique', (SELECT count(*) - count(DISTINCT p_partkey) FROM part) = 0 UNION ALL SELECT 'texts_present', (SELECT count(*) FROM documents WHERE text IS NULL) = 0""")
def a28_conformance(spark: SparkSession, d: str) -> DataFrame:
    """Named checks, each an anti join or an aggregate."""
    o, x = t(spark, d, "orders"), t(spark, d, "lineitem")
    lost = lambda df: df.agg((F.count("*") == 0).alias("passed"))
    checks = {
        "orders_have_customers": lost(o.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        "lineitems_have_orders": lost(x.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        "part_keys_unique": t(spark, d, "part").agg((F.count("*") == F.count_distinct("p_partkey")).alias("passed")),
        "texts_present": lost(t(spark, d, "documents").filter("text is null")),
    }
    out = None
    for name, df in checks.items():
        df = df.select(F.lit(name).alias("name"), "passed")
        out = df if out is None else out.unionByName(df)
    return out


@query(f"WITH {fx.SEGMENTS} SELECT segment, CASE WHEN live = 0 THEN 1.0 ELSE round(total / live, 9) END::DOUBLE AS amplification FROM segments")
def a29_write_amplification(spark: SparkSession, d: str) -> DataFrame:
    return fx.segments(spark, d).select("segment", F.when(F.col("live") == 0, 1.0).otherwise(F.round(F.col("total") / F.col("live"), 9)).alias("amplification"))


@query("SELECT count(DISTINCT text)::BIGINT AS exact, count(DISTINCT lang)::BIGINT AS langs FROM documents")
def a31_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct contents go through their digests, so that texts are not shuffled."""
    return t(spark, d, "documents").agg(F.count_distinct(F.sha2("text", 256)).alias("exact"), F.count_distinct("lang").alias("langs"))


@query("""SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*)::BIGINT AS n, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def a32_cube_addition(spark: SparkSession, d: str) -> DataFrame:
    """An addition: the reference has no grouping sets."""
    return t(spark, d, "orders").cube(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g"))


@query("""WITH i AS (SELECT DISTINCT l_partkey AS h FROM lineitem WHERE l_orderkey % 3 = 0)
SELECT p_partkey AS h, CASE WHEN p_partkey % 50 = 0 THEN 'hot' WHEN i.h IS NOT NULL THEN 'cold' ELSE 'miss' END AS probe FROM part LEFT JOIN i ON p_partkey = i.h""")
def j10_dedup_probe(spark: SparkSession, d: str) -> DataFrame:
    """Hot set, then index, else a definite miss. The runtime filters of the planner stand for the Bloom filter."""
    index = t(spark, d, "lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_partkey").alias("h")).distinct().withColumn("cold", F.lit(True))
    p = t(spark, d, "part").select(F.col("p_partkey").alias("h"))
    return p.join(index, "h", "left").select("h", F.when(F.col("h") % 50 == 0, "hot").when(F.col("cold"), "cold").otherwise("miss").alias("probe"))


@query(f"""WITH {fx.REFS}, s AS (SELECT hash FROM refs GROUP BY hash HAVING sum(delta) <= 0) SELECT p_partkey AS hash FROM part WHERE p_partkey NOT IN (SELECT hash FROM s) AND p_partkey IN (SELECT hash FROM refs)""")
def j11_liveness(spark: SparkSession, d: str) -> DataFrame:
    r = fx.refs(spark, d).groupBy("hash").agg(F.sum("delta").alias("n"))
    chunks = t(spark, d, "part").select(F.col("p_partkey").alias("hash"))
    return chunks.join(r.filter("n > 0"), "hash", "left_semi")


@query(f"WITH {fx.REFS} SELECT hash, hash * 8 AS block, sum(delta)::BIGINT AS refcount FROM refs GROUP BY hash HAVING sum(delta) > 0")
def j18_block_dedup_tree(spark: SparkSession, d: str) -> DataFrame:
    return fx.refs(spark, d).groupBy("hash").agg(F.sum("delta").alias("refcount")).filter("refcount > 0").select("hash", (F.col("hash") * 8).alias("block"), "refcount")


@query("""WITH l AS (SELECT o_custkey AS block, 0 AS layer, o_orderkey AS seq, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 1, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 2, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'),
r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY layer DESC, seq DESC) AS n FROM l) SELECT block, layer::BIGINT AS layer, v FROM r WHERE n = 1""")
def j12_layered_read(spark: SparkSession, d: str) -> DataFrame:
    """Own transaction (P) over pending groups (O), newest first, over disk (F): the first hit wins, as one maximum per block."""
    layer = F.when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0).cast("long")
    o = t(spark, d, "orders").filter(F.col("o_orderstatus").isin("P", "O", "F"))
    top = o.groupBy(F.col("o_custkey").alias("block")).agg(F.max(F.struct(layer.alias("layer"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("v"))).alias("m"))
    return top.select("block", "m.layer", "m.v")


@query("SELECT DISTINCT l_partkey AS hash, l_suppkey AS meta FROM lineitem WHERE l_returnflag <> 'R' UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'")
def u1_node_union(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed puts into two stores (lines not returned; lines that are closed): the same node twice is one node."""
    n = t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_partkey").alias("hash"), F.col("l_suppkey").alias("meta"))
    return n.filter("l_returnflag <> 'R'").unionByName(n.filter("l_linestatus = 'F'")).select("hash", "meta").dropDuplicates()


@query("""SELECT h, 'both' AS side FROM (SELECT l_partkey * 8 + l_linenumber AS h FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey * 8 + l_linenumber FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT h, 'left' FROM (SELECT l_partkey * 8 + l_linenumber AS h FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey * 8 + l_linenumber FROM lineitem WHERE l_returnflag = 'R')""")
def u2_set_tests(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of accepted lines against those of returned ones."""
    x = t(spark, d, "lineitem").select("l_returnflag", (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("h"))
    a, b = x.filter("l_returnflag = 'A'").select("h"), x.filter("l_returnflag = 'R'").select("h")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("left")))


@query("SELECT path FROM (SELECT o_custkey AS path FROM orders UNION SELECT c_custkey FROM customer) ORDER BY path")
def u3_path_union(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "orders").select(F.col("o_custkey").alias("path"))
    return a.union(t(spark, d, "customer").select("c_custkey")).distinct().orderBy("path")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_partkey AS k, l_orderkey AS first_order, l_linenumber::BIGINT AS first_line FROM r WHERE n = 1")
def u4_first_win_insert(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("m"))
    return g.select("k", F.col("m.l_orderkey").alias("first_order"), F.col("m.l_linenumber").cast("long").alias("first_line"))
