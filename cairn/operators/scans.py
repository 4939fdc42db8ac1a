"""Scans, lookups, overlays and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.registry import query
from cairn.sources import fixtures as fx
from cairn.sources.fixtures import t


@query("SELECT p_partkey AS k, p_name AS v FROM part ORDER BY k")
def s1_full_scan(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")).orderBy("k")


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey = 7")
def s2_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").filter("o_orderkey = 7").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))


def floor_lookup(table: DataFrame, key: str, probe: Column) -> DataFrame:
    """The row with the greatest key at or below the probe; a partial maximum in each task, no sort."""
    return table.filter(F.col(key) <= probe).agg(F.max_by(F.struct(*table.columns), key).alias("r")).filter("r is not null").select("r.*")


@query("SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey = (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey <= 57)")
def s3_floor_lookup(spark: SparkSession, d: str) -> DataFrame:
    return floor_lookup(t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), "k", F.lit(57))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 300")
def s4_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").filter("l_orderkey >= 100 and l_orderkey < 300").select("l_orderkey", "l_linenumber", "l_quantity")


def merge_messages(base: DataFrame, messages: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """Leaf rows overlaid by (key, seq, op, value) messages: the last one per key counts, `delete` drops the key.

    The newest message is a partial maximum per key, so only one row per key and task is shuffled.
    """
    rows = base.select(key, F.lit(-1).cast("long").alias("seq"), F.lit("upsert").alias("op"), value).unionByName(messages.select(key, "seq", "op", value))
    last = rows.groupBy(key).agg(F.max_by(F.struct("op", value), "seq").alias("m"))
    return last.filter("m.op <> 'delete'").select(key, F.col(f"m.{value}").alias(value))


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = t(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.round("c_acctbal", 2).alias("v"))
    op = F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert")
    return base, t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), op.alias("op"), F.round("o_totalprice", 2).alias("v"))


_TREE_SQL = """WITH m AS (
  SELECT c_custkey AS k, -1 AS seq, 'upsert' AS op, round(c_acctbal, 2) AS v FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'upsert' END, round(o_totalprice, 2) FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM m)
SELECT k, v FROM r WHERE n = 1 AND op <> 'delete'"""


@query(_TREE_SQL)
def s5_message_merged_scan(spark: SparkSession, d: str) -> DataFrame:
    return merge_messages(*_tree(spark, d))


@query(_TREE_SQL + " AND k IN (1, 2, 7, 10, 33)")
def s6_message_merged_get(spark: SparkSession, d: str) -> DataFrame:
    """The key filter goes below the union, so both scans are pruned."""
    base, messages = _tree(spark, d)
    keys = F.col("k").isin(1, 2, 7, 10, 33)
    return merge_messages(base.filter(keys), messages.filter(keys))


@query(f"WITH {fx.FILES} SELECT path, size FROM files WHERE starts_with(path, '/en/src1') ORDER BY path")
def s7_prefix_list(spark: SparkSession, d: str) -> DataFrame:
    return fx.files(spark, d).filter(F.col("path").startswith("/en/src1")).select("path", "size").orderBy("path")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS v2, p_retailprice AS v1 FROM part WHERE p_partkey IN (7, 8, 14)")
def s8_persistent_map_get(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a map: the second frame is derived, the first one stays as it was."""
    v1 = t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v1"))
    v2 = v1.withColumn("v2", F.when(F.col("k") % 7 == 0, F.col("v1") * 2).otherwise(F.col("v1")))
    return v2.filter(F.col("k").isin(7, 8, 14))


def replay_journal(log: DataFrame, order: str, valid: Column) -> DataFrame:
    """Rows before the first invalid one. The tear is one aggregate, so no row has to pass through a single sort."""
    tear = log.agg(F.min(F.when(~valid, F.col(order))).alias("_tear"))
    return log.crossJoin(F.broadcast(tear)).filter(F.col("_tear").isNull() | (F.col(order) < F.col("_tear"))).drop("_tear")


_LOG = "l AS (SELECT event_id AS seq, user_id AS txn, event_type AS kind, event_id <> 900 AS valid FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("txn"), F.col("event_type").alias("kind"), (F.col("event_id") != 900).alias("valid"))


@query(f"""WITH {_LOG}, p AS (SELECT * FROM l WHERE seq < coalesce((SELECT min(seq) FROM l WHERE NOT valid), 9223372036854775807)),
c AS (SELECT txn, max(seq) AS upto FROM p WHERE kind = 'purchase' GROUP BY txn)
SELECT p.txn, count(*)::BIGINT AS records, min(p.seq) AS first_seq, max(p.seq) AS last_seq FROM p JOIN c ON p.txn = c.txn AND p.seq < c.upto WHERE kind <> 'purchase' GROUP BY p.txn""")
def s9_wal_replay(spark: SparkSession, d: str) -> DataFrame:
    """Records of a transaction are visible once a commit of it was read before the first bad frame."""
    good = replay_journal(_log(spark, d), "seq", F.col("valid"))
    commits = good.filter("kind = 'purchase'").groupBy("txn").agg(F.max("seq").alias("upto"))
    rows = good.filter("kind <> 'purchase'").join(commits, "txn").filter("seq < upto")
    return rows.groupBy("txn").agg(F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"WITH {_LOG} SELECT seq, kind FROM l WHERE seq < (SELECT min(seq) FROM l WHERE NOT valid)")
def s10_journal_replay(spark: SparkSession, d: str) -> DataFrame:
    return replay_journal(_log(spark, d), "seq", F.col("valid")).select("seq", "kind")


def recover_blocks(tx: DataFrame, generation: int) -> DataFrame:
    """tx (tx_id, pos, payload): the first copy of an id wins, ids above the generation count, only the last run of consecutive ids is replayed."""
    first = tx.filter(F.col("tx_id") > generation).groupBy("tx_id").agg(F.min_by("payload", "pos").alias("payload"))
    # The last gap decides; it is found by an anti join on id - 1 rather than by a global sort.
    heads = first.join(first.select((F.col("tx_id") + 1).alias("tx_id")), "tx_id", "left_anti").agg(F.max("tx_id").alias("head"))
    return first.crossJoin(F.broadcast(heads)).filter("tx_id >= head").drop("head")


@query("""WITH tx AS (SELECT event_id AS tx_id, event_id AS pos, event_type AS payload FROM events WHERE event_id % 997 <> 5
  UNION ALL SELECT event_id, event_id + 1000000, 'copy' FROM events WHERE event_id % 11 = 0 AND event_id % 997 <> 5),
f AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY pos) AS n FROM tx WHERE tx_id > 50),
g AS (SELECT tx_id, payload, tx_id - row_number() OVER (ORDER BY tx_id) AS island FROM f WHERE n = 1)
SELECT tx_id, payload FROM g WHERE island = (SELECT max(island) FROM g)""")
def s11_block_recovery(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").filter("event_id % 997 <> 5")
    tx = e.select(F.col("event_id").alias("tx_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("payload"))
    copies = e.filter("event_id % 11 = 0").select(F.col("event_id").alias("tx_id"), (F.col("event_id") + 1000000).alias("pos"), F.lit("copy").alias("payload"))
    return recover_blocks(tx.unionByName(copies), 50)


@query(f"""WITH {fx.FILES}, r AS (SELECT path, size, digest, doc_id AS seq FROM files UNION ALL SELECT path, size + 1, 'dup', doc_id + 1000000 FROM files WHERE doc_id % 5 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS n FROM r)
SELECT path, size, digest, (SELECT count(*) FROM n WHERE n > 1)::BIGINT AS rejected FROM n WHERE n = 1""")
def s17_manifest_record(spark: SparkSession, d: str) -> DataFrame:
    """The first record of a path wins."""
    f = fx.files(spark, d).select("path", "size", "digest", F.col("doc_id").alias("seq"))
    again = f.filter("seq % 5 = 0").select("path", (F.col("size") + 1).alias("size"), F.lit("dup").alias("digest"), (F.col("seq") + 1000000).alias("seq"))
    kept = f.unionByName(again).groupBy("path").agg(F.min_by(F.struct("size", "digest"), "seq").alias("r"), (F.count("*") - 1).alias("more"))
    total = kept.agg(F.sum("more").alias("rejected"))
    return kept.crossJoin(F.broadcast(total)).select("path", "r.size", "r.digest", "rejected")


def gather(blocks: DataFrame, extents: DataFrame, stored: DataFrame) -> DataFrame:
    """Bytes of a file by logical block: extents fan out to blocks (equi join), holes read as zeros, blocks in order."""
    wide = extents.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("i"), "logical", "physical")
    wide = wide.select("file", (F.col("logical") + F.col("i")).alias("block"), (F.col("physical") + F.col("i")).alias("pblock"))
    wide = wide.groupBy("file", "block").agg(F.min("pblock").alias("pblock"))  # one mapping a block
    got = blocks.join(wide, ["file", "block"], "left").join(stored, "pblock", "left")
    return got.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("data", F.lit("0")).alias("data")))), lambda x: x["data"]), "").alias("content"))


@query(f"""WITH {fx.EXTENTS}, f AS (SELECT * FROM extents),
b AS (SELECT file, unnest(range(64, 64 + 32)) AS block FROM (SELECT DISTINCT file FROM f)),
m AS (SELECT b.file, b.block, min(physical + (block - logical)) AS pblock FROM b LEFT JOIN f ON f.file = b.file AND block >= logical AND block < logical + length GROUP BY 1, 2)
SELECT file, string_agg(coalesce((pblock % 7 + 1)::VARCHAR, '0'), '' ORDER BY block) AS content FROM m GROUP BY file""")
def s18_file_read(spark: SparkSession, d: str) -> DataFrame:
    f = fx.extents(spark, d)
    blocks = f.select("file").distinct().select("file", F.explode(F.sequence(F.lit(64).cast("long"), F.lit(95).cast("long"))).alias("block"))
    pb = f.select(F.explode(F.sequence(F.col("physical"), F.col("physical") + F.col("length") - 1)).alias("pblock")).distinct()
    return gather(blocks, f, pb.select("pblock", (F.col("pblock") % 7 + 1).cast("string").alias("data")))


@query(f"""WITH {fx.FILES} SELECT path, size, sha256(text) AS content FROM files WHERE path IN (SELECT path FROM files WHERE doc_id IN (3, 5, 8)) AND doc_id % 2 = 1""")
def s19_live_file_read(spark: SparkSession, d: str) -> DataFrame:
    """Resolve paths, then read; inodes that are compressed (even ids here) are refused."""
    f = fx.files(spark, d)
    wanted = f.filter(F.col("doc_id").isin(3, 5, 8)).select("path")
    return f.join(wanted, "path", "left_semi").filter("doc_id % 2 = 1").select("path", "size", F.sha2("text", 256).alias("content"))


@query("""SELECT o_orderkey AS block, CASE WHEN o_orderkey % 4 = 0 THEN 'cached:' || o_orderstatus ELSE 'disk:' || o_orderpriority END AS data FROM orders""")
def s20_cached_read(spark: SparkSession, d: str) -> DataFrame:
    """Cached pages lie over committed bytes."""
    disk = t(spark, d, "orders").select(F.col("o_orderkey").alias("block"), F.concat(F.lit("disk:"), "o_orderpriority").alias("committed"))
    pages = t(spark, d, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("block"), F.concat(F.lit("cached:"), "o_orderstatus").alias("page"))
    return disk.join(pages, "block", "left").select("block", F.coalesce("page", "committed").alias("data"))


@query("""WITH e AS (SELECT -2 AS pos, '.' AS name UNION ALL SELECT -1, '..' UNION ALL SELECT n_nationkey, n_name FROM nation)
SELECT pos::BIGINT AS pos, name FROM e ORDER BY pos LIMIT 7 OFFSET 5""")
def s21_directory_scan(spark: SparkSession, d: str) -> DataFrame:
    """Entries in stored order with `.` and `..` first; a page of them is the feature."""
    dots = spark.createDataFrame([(-2, "."), (-1, "..")], "pos long, name string")
    return dots.unionByName(t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("name"))).orderBy("pos").offset(5).limit(7)


@query("""WITH v AS (SELECT o_custkey AS path, o_orderkey AS seq, CASE WHEN o_orderkey % 9 = 0 THEN 'tombstone' ELSE 'file' END AS kind FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS n FROM v)
SELECT path, seq FROM l WHERE n = 1 AND kind <> 'tombstone'""")
def s25_tombstone_delete(spark: SparkSession, d: str) -> DataFrame:
    v = t(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 9 == 0, "tombstone").otherwise("file").alias("kind"))
    return v.groupBy("path").agg(F.max(F.struct("seq", "kind")).alias("m")).filter("m.kind <> 'tombstone'").select("path", "m.seq")


@query(f"""WITH {fx.IO_OPS}, c AS (SELECT op, count(*) AS n, sum(bytes) AS b FROM io_ops GROUP BY op)
SELECT 'io_ops_total{{op="' || op || '"}} ' || n AS line, 1::BIGINT AS family FROM c UNION ALL SELECT 'io_bytes_total{{op="' || op || '"}} ' || b::BIGINT, 0 FROM c""")
def s27_metrics_text(spark: SparkSession, d: str) -> DataFrame:
    """Text exposition rows, families by name and series by label."""
    c = fx.io_ops(spark, d).groupBy("op").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    line = lambda name, v: F.format_string(f'{name}{{op="%s"}} %d', "op", v)
    rows = c.select(line("io_ops_total", "n").alias("line"), F.lit(1).cast("long").alias("family"))
    return rows.unionByName(c.select(line("io_bytes_total", "b").alias("line"), F.lit(0).cast("long").alias("family"))).orderBy("family", "line")


@query(f"""WITH {fx.IO_OPS} SELECT '{{"reads":' || count(*) FILTER (op = 'read') || ',"writes":' || count(*) FILTER (op = 'write') || ',"bytes":' || sum(bytes)::BIGINT || '}}' AS json FROM io_ops""")
def s28_json_dashboard(spark: SparkSession, d: str) -> DataFrame:
    c = fx.io_ops(spark, d).agg(F.count_if(F.col("op") == "read").alias("reads"), F.count_if(F.col("op") == "write").alias("writes"), F.sum("bytes").alias("bytes"))
    return c.select(F.to_json(F.struct("reads", "writes", "bytes")).alias("json"))


#: Superblock magics by rule (kind, offset, magic, other magic), first match wins.
MAGICS = [
    ("ext4", 1080, "53EF", None), ("xfs", 0, "58465342", None), ("btrfs", 65280, "5F42485266535F4D", None), ("zfs", 0, "0CB1BA00", None), ("f2fs", 1024, "F00FF10F", None),
    ("ntfs", 3, "4E54465320202020", None), ("fat32", 82, "4641543332202020", None), ("exfat", 3, "4558464154202020", None), ("hfs+", 1024, "482B", "4858"), ("apfs", 32, "4E585342", None),
]


def detect_format(image: Column) -> Column:
    """The first rule whose magic (or other magic) lies within the image; null if none does."""
    out = F.lit(None).cast("string")
    for kind, offset, magic, other in reversed(MAGICS):
        got = F.hex(F.substring(image, offset + 1, len(magic) // 2))
        out = F.when(got.isin(*[m for m in (magic, other) if m]), kind).otherwise(out)
    return out


@query("""WITH i AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'XFSB' || text WHEN 1 THEN 'abcNTFS    ' || text WHEN 2 THEN 'abcEXFAT   ' || text ELSE text END AS image FROM documents)
SELECT doc_id, CASE WHEN starts_with(image, 'XFSB') THEN 'xfs' WHEN substr(image, 4, 8) = 'NTFS    ' THEN 'ntfs' WHEN substr(image, 4, 8) = 'EXFAT   ' THEN 'exfat' END AS kind FROM i""")
def s29_detect_format(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "XFSB").when(k == 1, "abcNTFS    ").when(k == 2, "abcEXFAT   ").otherwise("")
    return t(spark, d, "documents").select("doc_id", detect_format(F.concat(head, "text").cast("binary")).alias("kind"))
