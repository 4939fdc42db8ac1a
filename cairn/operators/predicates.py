"""Filters, access checks and policy tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.registry import query
from cairn.sources import fixtures as fx
from cairn.sources.fixtures import t


def lookup(key: Column, table: dict, default=None) -> Column:
    """A fixed table as nested cases."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, v).otherwise(out)
    return out


@query("SELECT n_name AS name FROM (SELECT '.' AS n_name UNION ALL SELECT '..' UNION ALL SELECT n_name FROM nation) WHERE n_name NOT IN ('.', '..')")
def f1_dot_entries(spark: SparkSession, d: str) -> DataFrame:
    dots = spark.createDataFrame([(".",), ("..",)], "name string")
    return dots.unionByName(t(spark, d, "nation").select(F.col("n_name").alias("name"))).filter(~F.col("name").isin(".", ".."))


def check_mode(mode: Column, uid: Column, gid: Column, owner: Column, group: Column, want: Column) -> Column:
    """Root and F_OK pass; else the first class that fits decides: owner, group, other."""
    bits = F.when(uid == owner, F.shiftright(mode, 6)).when(gid == group, F.shiftright(mode, 3)).otherwise(mode).bitwiseAND(7)
    return (uid == 0) | (want == 0) | (bits.bitwiseAND(want) == want)


_ACCESS = "a AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 512)::BIGINT AS mode, l_suppkey % 4 AS uid, l_partkey % 3 AS gid, l_orderkey % 4 AS owner, l_linenumber % 3 AS grp, l_orderkey % 8 AS want FROM lineitem)"


def _access(x: DataFrame) -> DataFrame:
    return x.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 512).alias("mode"), (F.col("l_suppkey") % 4).alias("uid"), (F.col("l_partkey") % 3).alias("gid"), (F.col("l_orderkey") % 4).alias("owner"), (F.col("l_linenumber") % 3).cast("long").alias("grp"), (F.col("l_orderkey") % 8).alias("want"))


@query(f"""WITH {_ACCESS} SELECT k, n, mode, uid = 0 OR want = 0 OR ((CASE WHEN uid = owner THEN mode >> 6 WHEN gid = grp THEN mode >> 3 ELSE mode END) & 7 & want) = want AS ok FROM a""")
def f2_mode_check(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _access(t(spark, d, "lineitem")).select("k", "n", "mode", check_mode(c("mode"), c("uid"), c("gid"), c("owner"), c("grp"), c("want")).alias("ok"))


def perm(acl: str, tag: str, ident: Column | None = None) -> Column:
    """The permission of the first entry with this tag (and id); null if there is none."""
    hit = F.filter(acl, lambda e: (e["tag"] == tag) & (F.lit(True) if ident is None else e["id"] == ident))
    return F.get(hit, F.lit(0))["perm"]


def evaluate_acl(acl: str, uid: Column, gid: Column, owner: Column, group: Column, want: Column) -> Column:
    """Owner unmasked; named user masked; owning and named group masked, any grants, a match denies the rest; then other."""
    mask = F.coalesce(perm(acl, "mask"), F.lit(65535))
    grants = lambda p, m=F.lit(65535): F.coalesce(p, F.lit(0)).bitwiseAND(m).bitwiseAND(want) == want
    user, named = perm(acl, "user", uid), perm(acl, "group", gid)
    in_group = (gid == group) | named.isNotNull()
    by_group = ((gid == group) & grants(perm(acl, "group_obj"), mask)) | (named.isNotNull() & grants(named, mask))
    return F.when(uid == owner, grants(perm(acl, "user_obj"))).when(user.isNotNull(), grants(user, mask)).when(in_group, by_group).otherwise(grants(perm(acl, "other")))


_ACL = """acl AS (SELECT c_custkey AS f, tag, id, perm FROM (
  SELECT c_custkey, 'user_obj' AS tag, NULL::BIGINT AS id, 7 AS perm FROM customer UNION ALL
  SELECT c_custkey, 'group_obj', NULL, c_nationkey % 8 FROM customer UNION ALL
  SELECT c_custkey, 'other', NULL, (c_custkey % 8)::INT FROM customer UNION ALL
  SELECT c_custkey, 'user', c_custkey % 5, ((c_custkey // 8) % 8)::INT FROM customer WHERE c_custkey % 2 = 0 UNION ALL
  SELECT c_custkey, 'group', c_custkey % 3, ((c_custkey // 3) % 8)::INT FROM customer WHERE c_custkey % 4 <> 1 UNION ALL
  SELECT c_custkey, 'mask', NULL, ((c_custkey // 5) % 8)::INT FROM customer WHERE c_custkey % 7 <> 0))"""


def _acl(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files with an access list: array of (tag, id, perm)."""
    k, none = F.col("c_custkey"), F.lit(None).cast("long")
    entry = lambda tag, i, p, when=F.lit(True): F.when(when, F.struct(F.lit(tag).alias("tag"), i.alias("id"), p.cast("int").alias("perm")))
    div = lambda n: F.floor(k / n) % 8
    entries = F.array(
        entry("user_obj", none, F.lit(7)), entry("group_obj", none, F.col("c_nationkey") % 8), entry("other", none, k % 8), entry("user", k % 5, div(8), k % 2 == 0),
        entry("group", k % 3, div(3), k % 4 != 1), entry("mask", none, div(5), k % 7 != 0),
    )
    return t(spark, d, "customer").select(k.alias("f"), F.filter(entries, lambda e: e.isNotNull()).alias("acl"))


@query(f"""WITH {_ACL}, p AS (SELECT f, max(perm) FILTER (tag = 'user_obj') AS uo, max(perm) FILTER (tag = 'group_obj') AS go, max(perm) FILTER (tag = 'other') AS ot,
  max(perm) FILTER (tag = 'user' AND id = f % 4) AS nu, max(perm) FILTER (tag = 'group' AND id = f % 2) AS ng, coalesce(max(perm) FILTER (tag = 'mask'), 65535) AS m, (f % 3 + 1)::INT AS want FROM acl GROUP BY f)
SELECT f, CASE WHEN f % 4 = f % 9 THEN (uo & want) = want WHEN nu IS NOT NULL THEN (nu & m & want) = want
  WHEN f % 2 = f % 6 OR ng IS NOT NULL THEN (f % 2 = f % 6 AND (go & m & want) = want) OR (ng IS NOT NULL AND (ng & m & want) = want) ELSE (ot & want) = want END AS ok FROM p""")
def f3_acl_evaluate(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("f")
    return _acl(spark, d).select("f", evaluate_acl("acl", f % 4, f % 2, f % 9, f % 6, (f % 3 + 1).cast("int")).alias("ok"))


@query(f"""WITH {_ACL} SELECT f, count(*) FILTER (tag = 'user_obj') = 1 AND count(*) FILTER (tag = 'group_obj') = 1 AND count(*) FILTER (tag = 'other') = 1 AND count(*) FILTER (tag = 'mask') <= 1
  AND (count(*) FILTER (tag = 'mask') = 1 OR count(*) FILTER (tag IN ('user', 'group')) = 0) AND count(*) FILTER (perm > 7) = 0 AS valid,
  string_agg(tag || coalesce(':' || id, ''), ',' ORDER BY CASE tag WHEN 'user_obj' THEN 0 WHEN 'user' THEN 1 WHEN 'group_obj' THEN 2 WHEN 'group' THEN 3 WHEN 'mask' THEN 4 ELSE 5 END, id) AS canonical FROM acl GROUP BY f""")
def f4_acl_validate(spark: SparkSession, d: str) -> DataFrame:
    n = lambda *tags: F.size(F.filter("acl", lambda e: e["tag"].isin(*tags)))
    named, ids = n("user", "group"), lambda tag: F.transform(F.filter("acl", lambda e: e["tag"] == tag), lambda e: e["id"])
    distinct = lambda tag: F.size(F.array_distinct(ids(tag))) == F.size(ids(tag))
    valid = (n("user_obj") == 1) & (n("group_obj") == 1) & (n("other") == 1) & (n("mask") <= 1) & ((n("mask") == 1) | (named == 0)) & ~F.exists("acl", lambda e: e["perm"] > 7) & distinct("user") & distinct("group")
    ranked = F.array_sort(F.transform("acl", lambda e: F.struct(lookup(e["tag"], {"user_obj": 0, "user": 1, "group_obj": 2, "group": 3, "mask": 4}, 5).alias("r"), e["id"].alias("id"), e["tag"].alias("tag"))))
    text = F.array_join(F.transform(ranked, lambda e: F.concat(e["tag"], F.coalesce(F.concat(F.lit(":"), e["id"].cast("string")), F.lit("")))), ",")
    return _acl(spark, d).select("f", valid.alias("valid"), text.alias("canonical"))


@query(f"""WITH {_ACL}, p AS (SELECT f, max(perm) FILTER (tag = 'user_obj') AS uo, max(perm) FILTER (tag = 'group_obj') AS go, max(perm) FILTER (tag = 'other') AS ot, max(perm) FILTER (tag = 'mask') AS m, max(perm) FILTER (tag = 'user') AS nu, max(perm) FILTER (tag = 'group') AS ng FROM acl GROUP BY f)
SELECT f, ((uo << 6) | ((go & coalesce(m, 7)) << 3) | ot)::BIGINT AS mode, ((6 << 6) | (CASE WHEN m IS NULL THEN 4 ELSE go & 4 END << 3) | 0)::BIGINT AS after_chmod,
  (((uo & 7) << 6) | (((go & 5) & coalesce(m, CASE WHEN (coalesce(nu, 0) | coalesce(ng, 0)) <> 0 THEN coalesce(nu, 0) | coalesce(ng, 0) END, 7)) << 3) | (ot & 0))::BIGINT AS inherited FROM p""")
def f5_acl_mode(spark: SparkSession, d: str) -> DataFrame:
    """Mode bits of the list; after chmod 0640 (the group bits go to the mask where there is one); of a child made with 0750."""
    p = lambda tag: F.coalesce(perm("acl", tag), F.lit(0))
    mode = lambda u, g, m, o: (F.shiftleft(u, 6).bitwiseOR(F.shiftleft(g.bitwiseAND(F.coalesce(m, F.lit(7))), 3)).bitwiseOR(o)).cast("long")
    mask = perm("acl", "mask")
    chmod = mode(F.lit(6), F.when(mask.isNull(), F.lit(4)).otherwise(p("group_obj")), F.when(mask.isNotNull(), F.lit(4)), F.lit(0))
    named = p("user").bitwiseOR(p("group"))
    inherited = mode(p("user_obj").bitwiseAND(7), p("group_obj").bitwiseAND(5), F.coalesce(mask, F.when(named != 0, named)), p("other").bitwiseAND(0))
    return _acl(spark, d).select("f", mode(p("user_obj"), p("group_obj"), mask, p("other")).alias("mode"), chmod.alias("after_chmod"), inherited.alias("inherited"))


#: File extensions that draw ransomware.
LURES = ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "pdf", "jpg", "jpeg", "png", "csv", "db"]


def is_lure(path: Column) -> Column:
    return path.rlike(r"(?i)^(?s:.*)\.(" + "|".join(LURES) + r")$")



@query("SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 2) THEN true ELSE false END AS lure FROM part")
def f7_lure_path(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    path = F.when(k == 0, F.concat(n, F.lit(".PDF"))).when(k == 1, F.lit("db")).when(k == 2, F.concat(n, F.lit(".docx"))).when(k == 3, F.concat(n, F.lit(".txt"))).otherwise(F.concat(n, F.lit("csv")))
    return t(spark, d, "part").select("p_partkey", is_lure(path).alias("lure"))


def evaluate_quota(now: Column, add_bytes: Column, add_inodes: Column) -> Column:
    """hard space, hard inodes, then soft space and soft inodes: denied once the grace is over, else warned; no spec: allowed."""
    c = F.col
    over = lambda limit, used, add: c(limit).isNotNull() & (c(used) + add > c(limit))

    def soft(limit: str, used: str, add: Column, since: str, name: str) -> tuple[Column, Column]:
        late = c(since).isNotNull() & (c("grace") > 0) & (now - c(since) > c("grace"))
        return over(limit, used, add), F.when(late, f"deny_{name}_grace").otherwise(f"warn_{name}")

    s, i = soft("soft_bytes", "used_bytes", add_bytes, "soft_since", "space"), soft("soft_inodes", "used_inodes", add_inodes, "soft_since", "inodes")
    return F.when(over("hard_bytes", "used_bytes", add_bytes), "deny_space").when(over("hard_inodes", "used_inodes", add_inodes), "deny_inodes").when(*s).when(*i).otherwise("allow")


@query("""WITH q AS (SELECT n_nationkey AS ns, CASE WHEN n_nationkey % 5 <> 0 THEN 300000 END AS hard_b, 60 AS hard_i, 200000 AS soft_b, 50 AS soft_i, 100 AS grace, CASE WHEN n_nationkey % 2 = 0 THEN 10 END AS since FROM nation WHERE n_nationkey % 7 <> 6),
u AS (SELECT c_nationkey AS ns, count(*) AS i, sum(floor(c_acctbal))::BIGINT AS b FROM customer GROUP BY 1)
SELECT u.ns::BIGINT AS ns, CASE WHEN b + 1000 > hard_b THEN 'deny_space' WHEN i + 1 > hard_i THEN 'deny_inodes'
  WHEN b + 1000 > soft_b THEN CASE WHEN 150 - since > grace THEN 'deny_space_grace' ELSE 'warn_space' END
  WHEN i + 1 > soft_i THEN CASE WHEN 150 - since > grace THEN 'deny_inodes_grace' ELSE 'warn_inodes' END ELSE 'allow' END AS decision FROM u LEFT JOIN q USING (ns)""")
def f8_quota(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    spec = t(spark, d, "nation").filter(n % 7 != 6).select(
        n.alias("ns"), F.when(n % 5 != 0, 300000).alias("hard_bytes"), F.lit(60).alias("hard_inodes"), F.lit(200000).alias("soft_bytes"), F.lit(50).alias("soft_inodes"), F.lit(100).alias("grace"), F.when(n % 2 == 0, 10).alias("soft_since"),
    )
    used = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("ns")).agg(F.count("*").alias("used_inodes"), F.sum(F.floor("c_acctbal")).alias("used_bytes"))
    return used.join(spec, "ns", "left").select(F.col("ns").cast("long").alias("ns"), evaluate_quota(F.lit(150), F.lit(1000), F.lit(1)).alias("decision"))


@query("SELECT p_partkey, (p_size & 4) = 4 AS has4, (p_size | 8)::BIGINT AS set8, (p_size & ~1)::BIGINT AS clear1 FROM part")
def f9_flag_bits(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", (s.bitwiseAND(4) == 4).alias("has4"), s.bitwiseOR(8).cast("long").alias("set8"), s.bitwiseAND(~1).cast("long").alias("clear1"))


def split_aligned(offset: Column, length: Column, unit: int) -> Column:
    """The parts of [offset, offset + length) between aligned boundaries."""
    first, last = F.floor(offset / unit), F.floor((offset + length - 1) / unit)
    part = lambda i: F.struct(F.greatest(offset, i * unit).alias("start"), (F.least(offset + length, (i + 1) * unit) - F.greatest(offset, i * unit)).alias("len"))
    return F.when(length > 0, F.transform(F.sequence(first, last), part)).otherwise(F.array())


@query(f"""WITH {fx.EXTENTS}, e AS (SELECT DISTINCT physical AS o, length * 7 AS n FROM extents),
x AS (SELECT o, n, unnest(range(o // 64, (o + n - 1) // 64 + 1)) AS i FROM e)
SELECT o AS offset, n AS len, (o // 64) * 64 AS low, ((o + n + 63) // 64) * 64 AS high, greatest(o, i * 64) AS part_start, least(o + n, (i + 1) * 64) - greatest(o, i * 64) AS part_len FROM x""")
def f10_alignment(spark: SparkSession, d: str) -> DataFrame:
    e = fx.extents(spark, d).select(F.col("physical").alias("offset"), (F.col("length") * 7).alias("len")).distinct()
    o, n = F.col("offset"), F.col("len")
    e = e.withColumn("p", F.explode(split_aligned(o, n, 64)))
    return e.select("offset", "len", (F.floor(o / 64) * 64).alias("low"), (F.ceil((o + n) / 64) * 64).alias("high"), F.col("p.start").alias("part_start"), F.col("p.len").alias("part_len"))


@query("""WITH b AS (SELECT s_suppkey AS band, s_suppkey * 1000 AS start, (s_suppkey * 37) % 900 AS wp, s_suppkey % 6 = 0 AS reclaiming FROM supplier WHERE s_suppkey % 4 <> 3)
SELECT l_orderkey, l_linenumber, CASE WHEN b.band IS NULL THEN 'ok' WHEN reclaiming OR l_suppkey * 1000 + (l_suppkey * 37) % 900 + (l_linenumber % 2) - start <> wp THEN 'rejected' ELSE 'ok' END AS verdict
FROM lineitem LEFT JOIN b ON l_suppkey = band""")
def f11_smr_write(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    bands = t(spark, d, "supplier").filter(s % 4 != 3).select(s.alias("band"), (s * 1000).alias("start"), ((s * 37) % 900).alias("wp"), (s % 6 == 0).alias("reclaiming"))
    k = F.col("l_suppkey")
    writes = t(spark, d, "lineitem").withColumn("offset", k * 1000 + (k * 37) % 900 + F.col("l_linenumber") % 2)
    bad = F.col("reclaiming") | (F.col("offset") - F.col("start") != F.col("wp"))
    return writes.join(bands, k == F.col("band"), "left").select("l_orderkey", "l_linenumber", F.when(F.col("band").isNull() | ~bad, "ok").otherwise("rejected").alias("verdict"))


@query(f"""WITH {fx.FREE_RUNS}, c AS (SELECT * FROM free_runs WHERE len >= 20)
SELECT (SELECT min(start) FROM c) AS first_fit, (SELECT min(start) FROM c WHERE len = (SELECT min(len) FROM c)) AS best_fit, (SELECT max(start) FROM c WHERE len = (SELECT max(len) FROM c)) AS worst_fit""")
def f12_allocation_fit(spark: SparkSession, d: str) -> DataFrame:
    """Least start; least length, the first of equals; greatest length, the last of equals."""
    c = fx.free_runs(spark, d).filter("len >= 20")
    return c.agg(F.min("start").alias("first_fit"), F.min(F.struct("len", "start"))["start"].alias("best_fit"), F.max(F.struct("len", "start"))["start"].alias("worst_fit"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 4032 THEN 'log' ELSE 'tree' END AS route FROM documents")
def f13_small_write_route(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.when(F.octet_length("text") <= 4032, "log").otherwise("tree").alias("route"))


@query("SELECT p_partkey, (p_size & ~15)::BIGINT AS unknown, (p_size & ~15) = 0 AND p_partkey % 4 <= 2 AS mountable FROM part")
def f14_feature_gate(spark: SparkSession, d: str) -> DataFrame:
    """Mountable: no feature bit beyond the known ones, and a version that is not newer than ours (2)."""
    unknown = F.col("p_size").bitwiseAND(~15)
    return t(spark, d, "part").select("p_partkey", unknown.cast("long").alias("unknown"), ((unknown == 0) & (F.col("p_partkey") % 4 <= 2)).alias("mountable"))


@query("SELECT o_orderkey, (substr(o_orderpriority, 1, 1)::INT * 8 + o_orderkey % 11 % 8)::BIGINT AS slot FROM orders")
def f15_priority_slot(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", (F.substring("o_orderpriority", 1, 1).cast("long") * 8 + F.col("o_orderkey") % 11 % 8).alias("slot"))


def import_plan(kind: Column, size: Column, mounted: Column) -> list[Column]:
    """Strategy, sign-off, progress steps, estimated bytes (low, high)."""
    strategy = F.when(~mounted, "raw-block").when(kind.isin("ntfs", "hfs+", "apfs"), "per-file").otherwise("tar-stream")
    steps = F.greatest(F.lit(1), F.least(F.lit(1000), F.floor(size / (1 << 20))))
    return [strategy.alias("strategy"), (~mounted).alias("signoff"), steps.cast("long").alias("steps"), F.expr("bytes * 62 div 100").alias("low"), size.alias("high")]


@query("""WITH i AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ntfs' WHEN 1 THEN 'ext4' WHEN 2 THEN 'apfs' ELSE 'xfs' END AS kind, p_size::BIGINT * 33554432 AS bytes, p_partkey % 5 <> 0 AS mounted FROM part)
SELECT p_partkey, CASE WHEN NOT mounted THEN 'raw-block' WHEN kind IN ('ntfs', 'apfs') THEN 'per-file' ELSE 'tar-stream' END AS strategy, NOT mounted AS signoff, least(1000, greatest(1, bytes // 1048576)) AS steps, bytes * 62 // 100 AS low, bytes AS high FROM i""")
def f16_import_strategy(spark: SparkSession, d: str) -> DataFrame:
    kind = lookup(F.col("p_partkey") % 4, {0: "ntfs", 1: "ext4", 2: "apfs"}, "xfs")
    i = t(spark, d, "part").select("p_partkey", kind.alias("kind"), (F.col("p_size").cast("long") * (1 << 25)).alias("bytes"), (F.col("p_partkey") % 5 != 0).alias("mounted"))
    return i.select("p_partkey", *import_plan(F.col("kind"), F.col("bytes"), F.col("mounted")))


@query("""WITH i AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'journal' WHEN 1 THEN 'leaves' WHEN 2 THEN 'bloom' WHEN 3 THEN 'staging' ELSE 'transient' END AS target, p_size % 2 = 0 AS pmem FROM part)
SELECT p_partkey, CASE WHEN pmem AND target <> 'transient' THEN 'cxl-pmem' ELSE 'dram' END AS tier, pmem AND target = 'staging' AS steer_dma, CASE WHEN pmem AND target <> 'transient' THEN 'clwb-fence' ELSE 'device-flush' END AS barrier FROM i""")
def f17_memory_tier(spark: SparkSession, d: str) -> DataFrame:
    target = lookup(F.col("p_partkey") % 5, {0: "journal", 1: "leaves", 2: "bloom", 3: "staging"}, "transient")
    pmem = F.col("p_size") % 2 == 0
    durable = pmem & (target != "transient")
    return t(spark, d, "part").select("p_partkey", F.when(durable, "cxl-pmem").otherwise("dram").alias("tier"), (pmem & (target == "staging")).alias("steer_dma"), F.when(durable, "clwb-fence").otherwise("device-flush").alias("barrier"))


#: Media class -> placement, natural alignment, append semantics.
MEDIA = [
    ("nvme-zns", "one-file-per-zone", 4096, True), ("nvme", "locality-clusters", 4096, False), ("ssd", "locality-clusters", 4096, False), ("hdd-smr", "band-confined", 262144000, True),
    ("hdd-pmr", "outer-lba-runs", 1048576, False), ("cxl-pmem", "pmem-first", 64, False), ("other", "best-effort", 4096, False),
]


@query("""WITH m(i, media, placement, unit, append) AS (VALUES (0, 'nvme-zns', 'one-file-per-zone', 4096, true), (1, 'nvme', 'locality-clusters', 4096, false), (2, 'ssd', 'locality-clusters', 4096, false), (3, 'hdd-smr', 'band-confined', 262144000, true), (4, 'hdd-pmr', 'outer-lba-runs', 1048576, false), (5, 'cxl-pmem', 'pmem-first', 64, false), (6, 'other', 'best-effort', 4096, false))
SELECT s_suppkey, media, placement, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 8192 END, unit)::BIGINT AS unit, append FROM supplier JOIN m ON s_suppkey % 7 = i""")
def f18_media_policy(spark: SparkSession, d: str) -> DataFrame:
    """A rule table of seven rows is broadcast; a probed alignment overrides the natural one."""
    m = spark.createDataFrame([(i, *r) for i, r in enumerate(MEDIA)], "i int, media string, placement string, unit long, append boolean")
    s = t(spark, d, "supplier")
    return s.join(F.broadcast(m), s["s_suppkey"] % 7 == m["i"]).select("s_suppkey", "media", "placement", F.coalesce(F.when(F.col("s_suppkey") % 3 == 0, 8192), "unit").cast("long").alias("unit"), "append")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 100 < 64 AND l_quantity * 1024 >= 16384 THEN 'qat' WHEN l_linenumber % 3 > 0 THEN 'simd' ELSE 'software' END AS backend FROM lineitem")
def f19_accelerator(spark: SparkSession, d: str) -> DataFrame:
    qat = (F.col("l_suppkey") % 2 == 0) & (F.col("l_partkey") % 100 < 64) & (F.col("l_quantity") * 1024 >= 16384)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(qat, "qat").when(F.col("l_linenumber") % 3 > 0, "simd").otherwise("software").alias("backend"))


def risk_band(x100: Column) -> Column:
    return F.when(x100 < 150, "healthy").when(x100 < 400, "watch").when(x100 < 1000, "degraded").otherwise("failing")


@query("SELECT p_partkey, CASE WHEN p_size * 25 < 150 THEN 'healthy' WHEN p_size * 25 < 400 THEN 'watch' WHEN p_size * 25 < 1000 THEN 'degraded' ELSE 'failing' END AS band FROM part")
def f20_risk_band(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", risk_band(F.col("p_size") * 25).alias("band"))


@query(f"""WITH {fx.IO_OPS}, m AS (SELECT ns % 20 AS ns, count(*) FILTER (op = 'read') AS r, count(*) FILTER (op = 'write') AS w, coalesce(sum(bytes) FILTER (op = 'read'), 0)::BIGINT AS rb, coalesce(sum(bytes) FILTER (op = 'write'), 0)::BIGINT AS wb FROM io_ops GROUP BY 1)
SELECT ns, CASE WHEN r + w = 0 THEN 'unknown' WHEN (CASE WHEN r > 0 THEN rb // r ELSE 0 END) > 1048576 AND r / (r + w) > 0.8 THEN 'media-streaming'
 WHEN (CASE WHEN r > 0 THEN rb // r ELSE 0 END) <= 16384 AND (CASE WHEN w > 0 THEN wb // w ELSE 0 END) <= 16384 AND r + w > 1000 THEN 'database'
 WHEN r / (r + w) < 0.2 AND (CASE WHEN w > 0 THEN wb // w ELSE 0 END) > 131072 THEN 'archive' ELSE 'desktop' END AS profile FROM m""")
def f21_workload_profile(spark: SparkSession, d: str) -> DataFrame:
    o = fx.io_ops(spark, d)
    agg = lambda op: [F.count_if(F.col("op") == op).alias(op), F.coalesce(F.sum(F.when(F.col("op") == op, F.col("bytes"))), F.lit(0)).alias(f"{op}_b")]
    m = o.groupBy((F.col("ns") % 20).alias("ns")).agg(*agg("read"), *agg("write"))
    mean = lambda op: F.when(F.col(op) > 0, F.expr(f"{op}_b div {op}")).otherwise(0)
    total = F.col("read") + F.col("write")
    share = F.when(total > 0, F.col("read") / total)
    p = F.when(total == 0, "unknown").when((mean("read") > 1 << 20) & (share > 0.8), "media-streaming").when((mean("read") <= 16384) & (mean("write") <= 16384) & (total > 1000), "database")
    return m.select("ns", p.when((share < 0.2) & (mean("write") > 1 << 17), "archive").otherwise("desktop").alias("profile"))


@query("""WITH f AS (SELECT s_suppkey AS device, CASE s_suppkey % 5 WHEN 0 THEN 'raid0' WHEN 1 THEN 'raid1' WHEN 2 THEN 'raid5' WHEN 3 THEN 'raid6' ELSE 'raid10' END AS profile, s_nationkey % 3 AS degraded FROM supplier),
s AS (SELECT *, CASE WHEN profile = 'raid0' THEN 'none' WHEN profile IN ('raid1', 'raid10') THEN CASE WHEN degraded > 0 THEN 'mirror' ELSE 'none' END WHEN profile = 'raid5' THEN 'parity-p' WHEN degraded = 0 THEN 'parity-p' WHEN degraded = 1 THEN 'parity-pq' ELSE 'none' END AS source FROM f)
SELECT device, source, CASE WHEN source = 'none' THEN 'quarantine,report-loss' ELSE 'quarantine,allocate,reconstruct,write,swap,release' END AS steps FROM s""")
def f23_repair_source(spark: SparkSession, d: str) -> DataFrame:
    profile = lookup(F.col("s_suppkey") % 5, {0: "raid0", 1: "raid1", 2: "raid5", 3: "raid6"}, "raid10")
    n = F.col("s_nationkey") % 3
    source = F.when(profile == "raid5", "parity-p").when(profile.isin("raid1", "raid10") & (n > 0), "mirror").when(profile == "raid6", F.when(n == 0, "parity-p").when(n == 1, "parity-pq").otherwise("none")).otherwise("none")
    steps = F.when(source == "none", F.array(*map(F.lit, ["quarantine", "report-loss"]))).otherwise(F.array(*map(F.lit, ["quarantine", "allocate", "reconstruct", "write", "swap", "release"])))
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("device"), source.alias("source"), F.array_join(steps, ",").alias("steps"))


@query(f"""WITH {fx.IO_OPS}, m AS (SELECT ns % 4 AS ns, count(*) FILTER (block % 5 < 2) AS hits, count(*) AS total FROM io_ops GROUP BY 1)
SELECT ns, 'increase cache size' AS advice FROM m WHERE total > 1000 AND hits / total < 0.5""")
def f24_recommendation(spark: SparkSession, d: str) -> DataFrame:
    m = fx.io_ops(spark, d).groupBy((F.col("ns") % 4).alias("ns")).agg(F.count_if(F.col("block") % 5 < 2).alias("hits"), F.count("*").alias("total"))
    return m.filter("total > 1000 and hits / total < 0.5").select("ns", F.lit("increase cache size").alias("advice"))


def resize_cache(windows: Column) -> Column:
    """Fold over (hits, misses) in order: below 80 % hits grow, above 98 % shrink to a floor."""

    def step(s: Column, w: Column) -> Column:
        total = w["hits"] + w["misses"]
        ratio = F.when(total > 0, w["hits"] / total)
        inodes = F.when(ratio < 0.8, s["inodes"] + 1000).when(ratio > 0.98, F.greatest(s["inodes"] - 500, F.lit(1000))).otherwise(s["inodes"])
        extents = F.when(ratio < 0.8, s["extents"] + 2000).when(ratio > 0.98, F.greatest(s["extents"] - 1000, F.lit(2000))).otherwise(s["extents"])
        return F.struct(inodes.cast("long").alias("inodes"), extents.cast("long").alias("extents"))

    zero = F.struct(F.lit(10000).cast("long").alias("inodes"), F.lit(20000).cast("long").alias("extents"))
    return F.aggregate(windows, zero, step)


@query(f"""WITH {fx.IO_OPS}, w AS (SELECT ns % 10 AS ns, t // 86400 AS day, count(*) FILTER (block % 50 < 49 - ns % 10 * 2) / count(*) AS r FROM io_ops GROUP BY 1, 2),
l AS (SELECT ns, list(r ORDER BY day) AS rs FROM w GROUP BY ns)
SELECT ns, list_reduce(rs, lambda s, r: CASE WHEN r < 0.8 THEN s + 1000 WHEN r > 0.98 THEN greatest(s - 500, 1000) ELSE s END, 10000.0)::BIGINT AS inodes,
 list_reduce(rs, lambda s, r: CASE WHEN r < 0.8 THEN s + 2000 WHEN r > 0.98 THEN greatest(s - 1000, 2000) ELSE s END, 20000.0)::BIGINT AS extents FROM l""")
def f25_cache_resize(spark: SparkSession, d: str) -> DataFrame:
    o = fx.io_ops(spark, d).withColumn("day", F.floor(F.col("t") / 86400)).withColumn("ns", F.col("ns") % 10)
    hit = F.col("block") % 50 < 49 - F.col("ns") * 2
    w = o.groupBy("ns", "day").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    seq = w.groupBy("ns").agg(F.array_sort(F.collect_list(F.struct("day", "hits", "misses"))).alias("w"))  # a row per day
    return seq.withColumn("c", resize_cache(F.col("w"))).select("ns", "c.inodes", "c.extents")


@query("""WITH e AS (SELECT o_orderkey AS seq, 'host' || o_custkey % 40 AS host, 'tag' || (o_orderkey % 60) AS tag FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq DESC) AS n FROM e), k AS (SELECT host, tag FROM l WHERE n = 1)
SELECT host, tag, count(*) OVER (PARTITION BY tag) = 1 AS unique_tag FROM k""")
def f26_export_table(spark: SparkSession, d: str) -> DataFrame:
    """Upsert by host path; a tag must belong to one host."""
    e = t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("host"), (F.col("o_custkey") % 40).cast("string")).alias("host"), F.concat(F.lit("tag"), (F.col("o_orderkey") % 60).cast("string")).alias("tag"))
    last = e.groupBy("host").agg(F.max_by("tag", "seq").alias("tag"))
    owners = last.groupBy("tag").agg(F.count("*").alias("n"))
    return last.join(owners, "tag").select("host", "tag", (F.col("n") == 1).alias("unique_tag"))
