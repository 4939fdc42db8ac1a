"""As-of lookups, diffs, manifests, path resolution and version graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.plans.registry import query
from cairn.shared import stash, workspace
from cairn.sources import fixtures as fx
from cairn.sources.fixtures import t


def verify_manifest(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Full outer join by path: ok, not_in_manifest, size_mismatch (before digest), digest_mismatch, missing."""
    m = manifest.select("path", F.col("size").alias("m_size"), F.col("digest").alias("m_digest"), F.lit(True).alias("_m"))
    o = observed.select("path", F.col("size").alias("o_size"), F.col("digest").alias("o_digest"), F.lit(True).alias("_o"))
    status = F.when(F.col("_m").isNull(), "not_in_manifest").when(F.col("_o").isNull(), "missing").when(F.col("m_size") != F.col("o_size"), "size_mismatch").when(F.col("m_digest") != F.col("o_digest"), "digest_mismatch").otherwise("ok")
    return m.join(o, "path", "full_outer").select("path", status.alias("status"))


_OBS = """o AS (SELECT path, CASE WHEN doc_id % 13 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 17 = 0 THEN 'bad' ELSE digest END AS digest FROM files WHERE doc_id % 11 <> 0
 UNION ALL SELECT path || '.new', size, digest FROM files WHERE doc_id % 19 = 0),
v AS (SELECT coalesce(f.path, o.path) AS path, CASE WHEN f.path IS NULL THEN 'not_in_manifest' WHEN o.path IS NULL THEN 'missing' WHEN f.size <> o.size THEN 'size_mismatch' WHEN f.digest <> o.digest THEN 'digest_mismatch' ELSE 'ok' END AS status FROM files f FULL JOIN o ON f.path = o.path)"""


def _verified(spark: SparkSession, d: str) -> DataFrame:
    f = fx.files(spark, d)
    i = F.col("doc_id")
    seen = f.filter(i % 11 != 0).select("path", F.when(i % 13 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(i % 17 == 0, "bad").otherwise(F.col("digest")).alias("digest"))
    extra = f.filter(i % 19 == 0).select(F.concat("path", F.lit(".new")).alias("path"), "size", "digest")
    return verify_manifest(f, seen.unionByName(extra))


@query(f"WITH {fx.FILES}, {_OBS} SELECT path, status FROM v")
def j1_manifest_verify(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d)


@query(f"WITH {fx.FILES}, {_OBS} SELECT count(*) FILTER (status <> 'missing')::BIGINT AS checked, count(*) FILTER (status <> 'ok')::BIGINT AS failures, count(*) FILTER (status <> 'ok') = 0 AND count(*) > 0 AS complete FROM v")
def s13_archive_verify(spark: SparkSession, d: str) -> DataFrame:
    v = _verified(spark, d)
    return v.agg(F.count_if(F.col("status") != "missing").alias("checked"), F.count_if(F.col("status") != "ok").alias("failures"), ((F.count_if(F.col("status") != "ok") == 0) & (F.count("*") > 0)).alias("complete"))


@query(f"WITH {fx.FILES}, {_OBS} SELECT count(*) FILTER (status NOT IN ('missing', 'not_in_manifest'))::BIGINT AS checked, count(*) FILTER (status IN ('size_mismatch', 'digest_mismatch'))::BIGINT AS corrupt, count(*) FILTER (status = 'digest_mismatch')::BIGINT AS healed, count(*) FILTER (status = 'size_mismatch')::BIGINT AS unhealable FROM v")
def a23_scrub_report(spark: SparkSession, d: str) -> DataFrame:
    """Recomputed digests against recorded ones; a block of the right size can be healed in place, one of another size can't."""
    s = F.col("status")
    return _verified(spark, d).agg(F.count_if(~s.isin("missing", "not_in_manifest")).alias("checked"), F.count_if(s.isin("size_mismatch", "digest_mismatch")).alias("corrupt"), F.count_if(s == "digest_mismatch").alias("healed"), F.count_if(s == "size_mismatch").alias("unhealable"))


@query(f"WITH {fx.FILES} SELECT count(*)::BIGINT AS entries, sum(size)::BIGINT AS total_bytes FROM files")
def a15_manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    return fx.files(spark, d).agg(F.count("*").alias("entries"), F.sum("size").alias("total_bytes"))


def snapshot_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, size, mtime) of two snapshots: added, removed, or modified if size or mtime differ. Every descendant path is a row."""
    j = a.select("path", F.struct("size", "mtime").alias("a")).join(b.select("path", F.struct("size", "mtime").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return j.select("path", change.alias("change")).filter("change is not null")


def _at(v: DataFrame, ts: int) -> DataFrame:
    """The state of every path at a time: the last version appended by then; one row a path and task is shuffled."""
    return v.filter(F.col("ts") <= ts).groupBy("path").agg(F.max_by(F.struct(F.col("content").alias("size"), F.col("ts").alias("mtime")), "pos").alias("v")).select("path", "v.size", "v.mtime")


_CUTS = (820454400, 852076800)  # 1996-01-01, 1997-01-01


@query(f"""WITH {fx.VERSIONS},
a AS (SELECT path, arg_max(content, pos) AS size, arg_max(ts, pos) AS mtime FROM versions WHERE ts <= {_CUTS[0]} GROUP BY path), b AS (SELECT path, arg_max(content, pos) AS size, arg_max(ts, pos) AS mtime FROM versions WHERE ts <= {_CUTS[1]} AND path % 17 <> 3 GROUP BY path)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR a.mtime <> b.mtime""")
def j2_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    v = fx.versions(spark, d)
    return snapshot_diff(_at(v, _CUTS[0]), _at(v.filter("path % 17 <> 3"), _CUTS[1]))


def as_of(left: DataFrame, right: DataFrame, *, on: str | None, left_time: str, right_time: str, tie: str, value: str) -> DataFrame:
    """Every left row with the value of the newest right row at or before its time; of one time the least tie key.

    Union and one sort by (key, time): the last right row seen so far is carried forward. No range join.
    Give `on` (or a coarser time bucket) for parallelism; without a key all times pass one sort.
    """
    key = [on] if on else []
    best = right.groupBy(*key, F.col(right_time).alias("_t")).agg(F.min_by(value, tie).alias("_v"))
    rows = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).unionByName(best.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("asof", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_t", "_side", "_v")


@query(f"""WITH {fx.SNAPSHOTS}, q AS (SELECT DISTINCT l_orderkey % 32 AS r, l_orderkey * 10 + l_linenumber AS pid, epoch(date_trunc('second', l_shipdate))::BIGINT AS ts FROM lineitem),
s AS (SELECT id % 32 AS r, "at", min(id) AS id FROM snapshots GROUP BY 1, 2)
SELECT q.r, pid, ts, s.id AS snapshot FROM q ASOF LEFT JOIN s ON q.r = s.r AND q.ts >= s."at" """)
def j3_snapshot_as_of(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "lineitem").select((F.col("l_orderkey") % 32).alias("r"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"), fx.epoch_s("l_shipdate").alias("ts")).distinct()
    s = fx.snapshots(spark, d).withColumn("r", F.col("id") % 32)
    return as_of(p, s, on="r", left_time="ts", right_time="at", tie="id", value="id").withColumnRenamed("asof", "snapshot")


@query(f"""WITH {fx.VERSIONS}, l AS (SELECT path, arg_max(content, pos) FILTER (ts <= {_CUTS[0]}) AS root, arg_min(content, pos) AS first FROM versions GROUP BY path)
SELECT path, coalesce(root, first) AS root, CASE WHEN root IS NULL THEN 'before_first' ELSE 'found' END AS status FROM l""")
def j4_root_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last root appended with ts <= t (append order decides, not time); if there is none, the first root."""
    v = fx.versions(spark, d)
    by = F.col("ts") <= _CUTS[0]
    l = v.groupBy("path").agg(F.max_by(F.when(by, F.col("content")), F.when(by, F.col("pos"))).alias("r"), F.min_by("content", "pos").alias("first"))  # noqa: E741
    return l.select("path", F.coalesce("r", "first").alias("root"), F.when(F.col("r").isNull(), "before_first").otherwise("found").alias("status"))


def resolve(edges: DataFrame, paths: DataFrame, root: int, depth: int = 8) -> DataFrame:
    """Walk paths component by component, one equi join a level: node, or the prefix that is missing."""
    parts = F.split(F.trim(F.col("path"), F.lit("/")), "/")
    cur = paths.select("path", parts.alias("parts"), F.lit(root).cast("long").alias("node"), F.lit(None).cast("string").alias("missing"))
    for level in range(depth):
        name = F.get("parts", F.lit(level))
        step = edges.select(F.col("parent").alias("node"), F.col("name").alias("_name"), F.col("child").alias("_child"))
        cur = cur.withColumn("_name", F.when(F.col("missing").isNull(), name)).join(step, ["node", "_name"], "left")
        lost = F.col("_name").isNotNull() & F.col("_child").isNull()
        cur = cur.select("path", "parts", F.coalesce("_child", "node").alias("node"), F.when(lost, F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, level + 1), "/"))).otherwise(F.col("missing")).alias("missing"))
    return cur.select("path", F.when(F.col("missing").isNull(), F.col("node")).alias("node"), "missing")


def namespace(spark: SparkSession, d: str) -> DataFrame:
    """Edges (parent, name, child): root 0 -> regions 1.. -> nations 100.. -> customers 1000.."""
    r = t(spark, d, "region").select(F.lit(0).cast("long").alias("parent"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 1).cast("long").alias("child"))
    n = t(spark, d, "nation").select((F.col("n_regionkey") + 1).cast("long").alias("parent"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).cast("long").alias("child"))
    c = t(spark, d, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("parent"), F.col("c_name").alias("name"), (F.col("c_custkey") + 1000).alias("child"))
    return r.unionByName(n).unionByName(c)


NAMESPACE = """ns AS (SELECT 0::BIGINT AS parent, r_name AS name, (r_regionkey + 1)::BIGINT AS child FROM region UNION ALL SELECT n_regionkey + 1, n_name, n_nationkey + 100 FROM nation UNION ALL SELECT c_nationkey + 100, c_name, c_custkey + 1000 FROM customer)"""


@query(f"""WITH {NAMESPACE}, a AS (SELECT '/' || r.name || '/' || n.name AS pre, n.child AS node FROM ns r JOIN ns n ON n.parent = r.child WHERE r.parent = 0),
p AS (SELECT a.pre || '/' || c.name AS path, c.child AS node, NULL AS missing FROM a JOIN ns c ON c.parent = a.node WHERE c.child % 10 = 0
 UNION ALL SELECT pre || '/nobody/x', NULL, pre || '/nobody' FROM a) SELECT path, node, missing FROM p""")
def j5_path_resolve(spark: SparkSession, d: str) -> DataFrame:
    e = namespace(spark, d)
    r, n, c = (e.select(*[F.col(x).alias(f"{s}_{x}") for x in e.columns]) for s in "rnc")
    a = r.filter("r_parent = 0").join(n, F.col("n_parent") == F.col("r_child")).select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("pre"), F.col("n_child").alias("node"))
    good = a.join(c.filter("c_child % 10 = 0"), F.col("c_parent") == F.col("node")).select(F.concat("pre", F.lit("/"), "c_name").alias("path"))
    return resolve(e, good.unionByName(a.select(F.concat("pre", F.lit("/nobody/x")).alias("path"))), 0, 4)


@query(f"""WITH {fx.VERSIONS}, l AS (SELECT path, arg_max(content, pos) AS size FROM versions WHERE ts <= {_CUTS[1]} GROUP BY path)
SELECT c_name AS name, size FROM l JOIN customer ON c_custkey = path WHERE c_nationkey = 7""")
def j6_list_at(spark: SparkSession, d: str) -> DataFrame:
    """A directory's rows at a time: as-of state joined with its entries."""
    entries = t(spark, d, "customer").filter("c_nationkey = 7").select(F.col("c_custkey").alias("path"), F.col("c_name").alias("name"))
    return _at(fx.versions(spark, d).join(entries.select("path"), "path", "left_semi"), _CUTS[1]).join(entries, "path").select("name", "size")


@query(f"""WITH {fx.SNAPSHOTS} SELECT id, "at" FROM snapshots ORDER BY "at", id""")
def t9_timeline(spark: SparkSession, d: str) -> DataFrame:
    return fx.snapshots(spark, d).orderBy("at", "id")


def merkle_diff(a: DataFrame, b: DataFrame, root: int, depth: int) -> DataFrame:
    """Level-wise diff of two trees (parent, name, child, hash): equal hashes are pruned; added and removed subtrees are one row.

    Every level reads both trees and the level before, which are tables in the shared folder until the diff is done.
    """
    spark = a.sparkSession
    with workspace(spark):
        a, b = stash(a, "tree"), stash(b, "tree")
        level = spark.createDataFrame([("", root, root)], "path string, x long, y long")
        out = None
        for _ in range(depth):
            left = level.join(a.select(F.col("parent").alias("x"), "name", F.col("child").alias("x2"), F.col("hash").alias("hx")), "x").select("path", "name", "x2", "hx")
            right = level.join(b.select(F.col("parent").alias("y"), "name", F.col("child").alias("y2"), F.col("hash").alias("hy")), "y").select("path", "name", "y2", "hy")
            both = left.join(right, ["path", "name"], "full_outer").filter(~F.col("hx").eqNullSafe(F.col("hy")))
            both = stash(both.select(F.concat("path", F.lit("/"), "name").alias("path"), F.col("x2").alias("x"), F.col("y2").alias("y")), "tree-level")
            rows = both.select("path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("modified").alias("change"), "x")
            out = rows if out is None else out.unionByName(rows)
            level = both.filter("x is not null and y is not null")
        inner = a.select(F.col("parent").alias("x"), F.lit(True).alias("_dir")).distinct()  # directories show through their children
        return stash(out.join(inner, "x", "left").filter("change <> 'modified' or _dir is null").select("path", "change"), "tree-diff", keep=True)


def _hashed(e: DataFrame, odd: str) -> DataFrame:
    """Hashes from the leaves up: a directory's hash covers its children's names and hashes."""
    leaf = e.filter("child >= 1000").select("parent", "name", "child", F.sha2(F.concat_ws("|", "name", F.expr(odd)), 256).alias("hash"))
    up = lambda kids, lo, hi: e.filter(f"child >= {lo} and child < {hi}").join(kids.groupBy(F.col("parent").alias("child")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("name", "hash"))), ""), 256).alias("hash")), "child").select("parent", "name", "child", "hash")
    nations = up(leaf, 100, 1000)
    return leaf.unionByName(nations).unionByName(up(nations, 1, 100))


@query(f"""WITH {NAMESPACE}, n AS (SELECT '/' || r.name || '/' || n.name AS pre, n.child FROM ns r JOIN ns n ON n.parent = r.child WHERE r.parent = 0)
SELECT pre || '/' || c.name AS path, CASE WHEN c.child % 40 = 1 THEN 'removed' ELSE 'modified' END AS change FROM n JOIN ns c ON c.parent = n.child WHERE c.child % 40 IN (1, 2)""")
def j13_merkle_diff(spark: SparkSession, d: str) -> DataFrame:
    e = namespace(spark, d)
    return merkle_diff(_hashed(e, "'0'"), _hashed(e.filter("child < 1000 or child % 40 <> 1"), "case when child % 40 = 2 then '1' else '0' end"), 0, 3)


def ancestry(nodes: DataFrame) -> DataFrame:
    """nodes (node, parent; null at a root), one parent each -> node, ancestors, oldest, of those that have a parent.

    Pointer doubling: every node holds how far it has looked and from where to look on, so each round doubles the reach,
    and the table keeps one row a node: joins grow with the logarithm of the depth, rows not at all.
    """
    with workspace(nodes.sparkSession):
        held = stash(nodes.select("node", F.col("parent").alias("at"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("n")), "ancestry")
        while True:
            step = held.filter("at is not null").select(F.col("node").alias("_node"), F.col("at").alias("_at"), F.col("n").alias("_n"))
            new = held.join(step, F.col("at") == F.col("_node"), "left").select("node", F.coalesce("_at", "at").alias("at"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.col("_at").isNotNull().alias("moved"))
            new = stash(new, "ancestry")
            if not new.filter("moved").limit(1).count():
                return stash(new.filter("at is not null").select("node", F.col("n").alias("ancestors"), F.col("at").alias("oldest")), "ancestry", keep=True)
            held = new.drop("moved")


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS c, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders),
r AS (SELECT c AS start, parent AS anc FROM p WHERE parent IS NOT NULL UNION ALL SELECT r.start, p.parent FROM r JOIN p ON r.anc = p.c WHERE p.parent IS NOT NULL)
SELECT start, count(DISTINCT anc)::BIGINT AS ancestors, min(anc) AS oldest FROM r GROUP BY start""")
def j14_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """The version chain of every customer's orders: how many versions lie before each one, and the first."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    chain = t(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.lag("o_orderkey").over(w).alias("parent"))
    return ancestry(chain).withColumnRenamed("node", "start")


def compare_clocks(a: str, b: str) -> Column:
    """before, after, equal or concurrent; missing entries count as 0."""
    le = lambda x, y: F.forall(F.map_entries(x), lambda e: e["value"] <= F.coalesce(F.element_at(y, e["key"]), F.lit(0)))
    ab, ba = le(a, b), le(b, a)
    return F.when(ab & ba, "equal").when(ab, "before").when(ba, "after").otherwise("concurrent")


def merge_clocks(a: str, b: str) -> Column:
    """Pointwise maximum."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def _clocks(spark: SparkSession, d: str) -> DataFrame:
    k, m = F.col("p_partkey"), lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    num = lambda c: c.cast("long")
    return t(spark, d, "part").select(k.alias("k"), m("a", num(k % 3), "b", num(k % 5)).alias("x"), m("a", num(k % 4), "c", num(k % 2)).alias("y"))


_CLOCKS = "c AS (SELECT p_partkey AS k, p_partkey % 3 AS xa, p_partkey % 5 AS xb, p_partkey % 4 AS ya, p_partkey % 2 AS yc FROM part)"


@query(f"""WITH {_CLOCKS} SELECT k, CASE WHEN xa = ya AND xb = 0 AND yc = 0 THEN 'equal' WHEN xa <= ya AND xb = 0 THEN 'before' WHEN ya <= xa AND yc = 0 THEN 'after' ELSE 'concurrent' END AS relation,
 greatest(xa, ya) AS a, xb AS b, yc AS c, greatest(xa, ya) + xb + yc AS total FROM c""")
def a18_vector_clocks(spark: SparkSession, d: str) -> DataFrame:
    c = _clocks(spark, d).withColumn("m", merge_clocks("x", "y"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, v: s + v)
    return c.select("k", compare_clocks("x", "y").alias("relation"), *[F.element_at("m", n).alias(n) for n in "abc"], total.alias("total"))


@query(f"""WITH {_CLOCKS} SELECT k, CASE WHEN xa <= ya AND xb = 0 THEN 'theirs' WHEN ya <= xa AND yc = 0 THEN 'ours' ELSE 'merge' END AS winner,
 CASE WHEN NOT (xa <= ya AND xb = 0) AND NOT (ya <= xa AND yc = 0) THEN greatest(xa, ya) + 1 END AS merged_a FROM c""")
def j15_merge_heads(spark: SparkSession, d: str) -> DataFrame:
    """A dominated side loses; concurrent sides make a merge node whose clock is the maximum, then ours goes up by one."""
    rel = compare_clocks("x", "y")
    merged = F.when(rel == "concurrent", F.element_at(merge_clocks("x", "y"), "a") + 1)
    return _clocks(spark, d).select("k", F.when(rel.isin("before", "equal"), "theirs").when(rel == "after", "ours").otherwise("merge").alias("winner"), merged.alias("merged_a"))


@query("""WITH p AS (SELECT p_partkey AS pos, p_name || '/' || p_brand AS h, p_size FROM part), a AS (SELECT * FROM p WHERE p_size <= 30), o AS (SELECT * FROM p WHERE p_size BETWEEN 11 AND 40), th AS (SELECT * FROM p WHERE p_size > 20),
g AS (SELECT 0 AS grp, pos, h FROM o WHERE h NOT IN (SELECT h FROM a) UNION ALL SELECT 1, pos, h FROM th WHERE h NOT IN (SELECT h FROM a) AND h NOT IN (SELECT h FROM o)
 UNION ALL SELECT 2, pos, h FROM a WHERE h IN (SELECT h FROM o) OR h IN (SELECT h FROM th)) SELECT grp::BIGINT AS grp, pos, h FROM g""")
def j16_three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    """Chunks new in ours, then new in theirs only, then those of the ancestor that either side kept."""
    p = t(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.concat_ws("/", "p_name", "p_brand").alias("h"), "p_size")
    a, ours, theirs = p.filter("p_size <= 30"), p.filter("p_size between 11 and 40"), p.filter("p_size > 20")
    h = lambda x: x.select("h").distinct()
    parts = [ours.join(h(a), "h", "left_anti"), theirs.join(h(a), "h", "left_anti").join(h(ours), "h", "left_anti"), a.join(h(ours.unionByName(theirs)), "h", "left_semi")]
    out = None
    for i, x in enumerate(parts):
        x = x.select(F.lit(i).cast("long").alias("grp"), "pos", "h")
        out = x if out is None else out.unionByName(x)
    return out.orderBy("grp", "pos")


@query(f"""WITH RECURSIVE {NAMESPACE}, r AS (SELECT child, 1 AS depth FROM ns WHERE parent = 0 UNION ALL SELECT ns.child, depth + 1 FROM ns JOIN r ON ns.parent = r.child)
SELECT max(depth)::BIGINT + 1 AS height, count(*)::BIGINT + 1 AS nodes, count(*) FILTER (child >= 1000)::BIGINT AS leaves FROM r""")
def a30_tree_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A frontier of nodes a level, until it is empty."""
    e = namespace(spark, d)
    level, stats, depth = e.filter("parent = 0").select("child"), [], 0
    while (row := level.agg(F.count("*"), F.count_if(F.col("child") >= 1000)).first())[0]:
        depth += 1
        stats.append((depth, *row))
        level = level.select(F.col("child").alias("parent")).join(e, "parent").select("child")
    s = spark.createDataFrame(stats, "depth long, n long, leaves long")
    return s.agg((F.max("depth") + 1).alias("height"), (F.sum("n") + 1).alias("nodes"), F.sum("leaves").alias("leaves"))
