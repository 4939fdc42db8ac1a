"""Order-dependent operators: EWMAs, retention, hysteresis, rate limits, buckets, fair queues, zone plans.

Folds that a window cannot express read rows sorted by key and order, in Arrow batches, and carry one key's state from
row to row: time is linear in the rows and memory does not depend on how many a key has, so a key may hold a large part
of all rows. Where a key's rows are bounded by their nature (a window a day), `aggregate` over an array folds inside the
JVM. The streaming twins keep the same state across micro-batches (cairn.streaming).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.plans.registry import query
from cairn.sources import fixtures as fx
from cairn.sources.fixtures import t


def in_order(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row per key: its rows as an array of structs in order."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("rows"))


def fold(start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate("rows", start, step)


_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _carried(rows: DataFrame, keys: list[str], order: list[str], values: list[str], start: tuple, step: Callable, out: str, last: bool) -> DataFrame:
    names, kinds = zip(*(c.split() for c in out.split(", ")), strict=True)
    n, width = len(keys), len(keys) + (0 if last else len(order) + len(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start

        def put(heads: list, made: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*heads, *(pa.array(c, _ARROW[k]) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names=heads_ + list(names))

        heads_ = [*keys] if last else [*keys, *order, *values]
        types: list = []
        for b in batches:
            types = [f.type for f in b.schema][:n]
            ended, made = [], []
            for k, v in zip(zip(*(c.to_pylist() for c in b.columns[:n]), strict=True), zip(*(c.to_pylist() for c in b.columns[n:]), strict=True), strict=True):
                if k != key:
                    if last and key is not None:
                        ended.append((key, state))
                    key, state = k, start
                state, row = step(state, *v)
                if not last:
                    made.append(row)
            if made:
                yield put(b.columns[:width], made)
            if ended:
                yield put([pa.array(c, ty) for c, ty in zip(zip(*(k for k, _ in ended), strict=True), types, strict=True)], [s for _, s in ended])
        if last and key is not None:
            yield put([pa.array([x], ty) for x, ty in zip(key, types, strict=True)], [state])

    dealt = rows.select(*keys, *order, *values).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields[:width]] + [out])
    return dealt.mapInArrow(run, schema)


def scan_in_order(rows: DataFrame, keys: list[str], order: list[str], values: list[str], start: tuple, step: Callable[..., tuple[tuple, tuple]], out: str) -> DataFrame:
    """Every row with what `step(state, *order, *values) -> (state, output)` gives for it, a key's rows in order."""
    return _carried(rows, keys, order, values, start, step, out, False)


def fold_in_order(rows: DataFrame, keys: list[str], order: list[str], values: list[str], start: tuple, step: Callable[..., tuple], out: str) -> DataFrame:
    """One row per key: the state after all of its rows, `step(state, *order, *values) -> state`."""
    return _carried(rows, keys, order, values, start, lambda s, *v: (step(s, *v), None), out, True)


def long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def quarter(old: Column, sample: Column) -> Column:
    """EWMA with weight 1/4 in 32.32 fixed point: floor((sample + 3 old) / 4)."""
    return F.shiftright(sample + 3 * old, 2)


def div(a: Column, b: Column) -> Column:
    """Floor of a quotient of non-negative longs; exact below 2^53 and by remainder beyond."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def idiv(a: str, b: str) -> Column:
    return F.expr(f"{a} div {b}")


def io_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows by namespace group: ops, bytes, reads, syncs, longest run."""
    o = fx.io_ops(spark, d).withColumn("day", F.floor(F.col("t") / 86400)).withColumn("g", F.col("ns") % 16)
    return o.groupBy("g", "day").agg(F.count("*").alias("ops"), F.sum("bytes").alias("bytes"), F.count_if(F.col("op") == "read").alias("reads"), F.count_if(F.col("op") == "sync").alias("syncs"), F.max("bytes").alias("run"))


WINDOWS = f"""{fx.IO_OPS}, win AS (SELECT ns % 16 AS g, t // 86400 AS day, count(*) AS ops, sum(bytes)::BIGINT AS bytes, count(*) FILTER (op = 'read') AS reads, count(*) FILTER (op = 'sync') AS syncs, max(bytes) AS run FROM io_ops GROUP BY 1, 2),
sam AS (SELECT g, day, least(bytes // ops, 1048576) * 4294967296 AS s, reads * 4294967296 // ops AS r, syncs * 4294967296 // ops AS y, CASE WHEN bytes = 0 THEN 0 ELSE run * 4294967296 // bytes END AS q FROM win),
lst AS (SELECT g, list(s ORDER BY day) AS s, list(r ORDER BY day) AS r, list(y ORDER BY day) AS y, list(q ORDER BY day) AS q FROM sam GROUP BY g),
ew AS (SELECT g, {", ".join(f"list_reduce({c}, lambda o, x: (x + 3 * o) // 4, 0::BIGINT) AS {c}" for c in "sryq")} FROM lst)"""


def workload_ewma(windows: DataFrame, key: str, order: str) -> DataFrame:
    """EWMAs of size, read, sync and sequential share over windows with operations."""
    w = windows.filter("ops > 0").select(
        key, order, F.shiftleft(F.least(idiv("bytes", "ops"), F.lit(1 << 20)), 32).alias("s"), F.expr("shiftleft(reads, 32) div ops").alias("r"), F.expr("shiftleft(syncs, 32) div ops").alias("y"),
        F.expr("case when bytes = 0 then 0 else shiftleft(run, 32) div bytes end").alias("q"),
    )
    zero = F.struct(*[long(0).alias(c) for c in "sryq"])
    step = lambda a, x: F.struct(*[quarter(a[c], x[c]).alias(c) for c in "sryq"])
    return in_order(w, [key], [order], list("sryq")).select(key, fold(zero, step).alias("e")).select(key, "e.*")


@query(f"WITH {WINDOWS} SELECT g, s, r, y, q FROM ew")
def w1_window_ewma(spark: SparkSession, d: str) -> DataFrame:
    return workload_ewma(io_windows(spark, d), "g", "day")


def stream_class(size: Column, read: Column, sync: Column, seq: Column) -> Column:
    """Meta, stream, log, db, vm, vhost: the first rule that fits. size in bytes, shares in 32.32."""
    share = lambda n, m: (n << 32) // m
    mid = (size >= 4096) & (size <= 65536)
    return (
        F.when((size < 1024) & (seq < share(2, 10)), "meta")
        .when((size >= 1 << 18) & (read >= share(8, 10)) & (seq >= 1 << 31), "stream")
        .when((size >= 1 << 18) & (read < share(2, 10)) & (seq >= share(8, 10)), "log")
        .when((sync >= share(5, 100)) & mid, "db")
        .when(mid & (seq < share(2, 10)), "vm")
        .otherwise("vhost")
    )


_CLASS = """CASE WHEN {s} < 1024 AND {q} < 858993459 THEN 'meta' WHEN {s} >= 262144 AND {r} >= 3435973836 AND {q} >= 2147483648 THEN 'stream' WHEN {s} >= 262144 AND {r} < 858993459 AND {q} >= 3435973836 THEN 'log'
 WHEN {y} >= 214748364 AND {s} BETWEEN 4096 AND 65536 THEN 'db' WHEN {s} BETWEEN 4096 AND 65536 AND {q} < 858993459 THEN 'vm' ELSE 'vhost' END"""


@query(f"WITH {WINDOWS} SELECT g, {_CLASS.format(s='(s // 4294967296)', r='r', y='y', q='q')} AS class FROM ew")
def f22_stream_class(spark: SparkSession, d: str) -> DataFrame:
    e = workload_ewma(io_windows(spark, d), "g", "day")
    return e.select("g", stream_class(F.shiftright("s", 32), F.col("r"), F.col("y"), F.col("q")).alias("class"))


_DAYCLASS = _CLASS.format(s="(bytes // ops)", r="(reads * 4294967296 // ops)", y="(syncs * 4294967296 // ops)", q="(run * 4294967296 // bytes)")


@query(f"WITH {WINDOWS}, c AS (SELECT g, day, {_DAYCLASS} AS class FROM win), l AS (SELECT *, lag(class) OVER (PARTITION BY g ORDER BY day) AS was FROM c) SELECT g, day, was, class FROM l WHERE class IS DISTINCT FROM was")
def w8_workload_shift(spark: SparkSession, d: str) -> DataFrame:
    w = io_windows(spark, d)
    ratio = lambda c, by: F.expr(f"shiftleft({c}, 32) div {by}")
    c = w.select("g", "day", stream_class(idiv("bytes", "ops"), ratio("reads", "ops"), ratio("syncs", "ops"), ratio("run", "bytes")).alias("class"))
    was = F.lag("class").over(Window.partitionBy("g").orderBy("day"))
    return c.withColumn("was", was).filter(~F.col("class").eqNullSafe(F.col("was"))).select("g", "day", "was", "class")


def suspicion(entropy: Column, rewrite: Column, lure: Column) -> list[Column]:
    """Basis points of suspicion and whether to freeze: half entropy (full at 7.5 bits), 3/10 rewrites, 2/10 lures, all in 32.32."""
    full = 15 << 31
    evidence = F.floor(F.least(entropy, F.lit(full)).cast("decimal(20,0)") * (1 << 32) / full).cast("long")
    tenth = lambda x, n: div(x, F.lit(10).cast("long")) * n
    total = div(evidence, F.lit(2).cast("long")) + tenth(rewrite, 3) + tenth(lure, 2)
    bps = F.least(F.shiftright(total * 10000, 32), F.lit(10000))
    return [bps.alias("score_bps"), (bps >= 8000).alias("freeze")]


@query("""WITH i AS (SELECT p_partkey AS k, (p_partkey * 17179869) % 34359738368 AS e, (p_partkey * 2147483) % 4294967296 AS r, (p_size::BIGINT * 85899345) AS l FROM part),
c AS (SELECT k, ((least(e, 32212254720)::HUGEINT * 4294967296 // 32212254720)::BIGINT // 2 + r // 10 * 3 + l // 10 * 2) AS t FROM i)
SELECT k, least(10000, t * 10000 // 4294967296)::BIGINT AS score_bps, t * 10000 // 4294967296 >= 8000 AS freeze FROM c""")
def w2_suspicion(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return t(spark, d, "part").select(p.alias("k"), *suspicion((p * 17179869) % (1 << 35), (p * 2147483) % (1 << 32), F.col("p_size").cast("long") * 85899345))


@query(f"""WITH {fx.IO_OPS}, l AS (SELECT ns, list(latency_us ORDER BY seq) AS v FROM io_ops WHERE op = 'read' GROUP BY ns)
SELECT ns, list_reduce(v, lambda c, n: c - (c >> 3) + (n >> 3)) AS ewma FROM l""")
def w3_latency_ewma(spark: SparkSession, d: str) -> DataFrame:
    """The first sample sets the average; then an eighth of old is replaced by an eighth of new."""
    step = lambda s, _, x: (x if s[0] is None else s[0] - (s[0] >> 3) + (x >> 3),)
    return fold_in_order(fx.io_ops(spark, d).filter("op = 'read'"), ["ns"], ["seq"], ["latency_us"], (None,), step, "ewma long")


def retention(snaps: DataFrame, hourly: int, daily: int, weekly: int, monthly: int, yearly: int) -> DataFrame:
    """Kept snapshots (id, at, tier). Hourly keeps the newest; each later tier keeps, of what is not kept yet, the newest of every
    bucket, newest buckets first, up to its budget. One row per bucket reaches the ranking, not the snapshots."""
    day = F.floor(F.col("at") / 86400)
    iso_year = F.expr("extract(yearofweek from date_from_unix_date(cast(floor(at / 86400) as int)))")
    date = F.expr("date_from_unix_date(cast(floor(at / 86400) as int))")
    keys = {"daily": (day, daily), "weekly": (iso_year * 100 + F.weekofyear(date), weekly), "monthly": (F.year(date) * 12 + F.month(date) - 1, monthly), "yearly": (F.year(date), yearly)}
    newest = [F.desc("at"), F.desc("id")]
    kept = snaps.orderBy(*newest).limit(hourly).withColumn("tier", F.lit("hourly"))
    left = snaps.join(kept.select("id"), "id", "left_anti")
    for tier, (bucket, budget) in keys.items():
        best = left.groupBy(bucket.alias("_k")).agg(F.max(F.struct("at", "id")).alias("m")).select("m.id", "m.at")
        take = best.orderBy(*newest).limit(budget).withColumn("tier", F.lit(tier))
        kept = kept.unionByName(take)
        left = left.join(take.select("id"), "id", "left_anti")
    return kept


def _retention_sql(budgets: dict[str, int]) -> str:
    key = {"daily": '"at" // 86400', "weekly": "isoyear(make_date(1970, 1, 1) + ((\"at\" // 86400)::INT)) * 100 + week(make_date(1970, 1, 1) + ((\"at\" // 86400)::INT))", "monthly": "year(make_date(1970, 1, 1) + ((\"at\" // 86400)::INT)) * 12 + month(make_date(1970, 1, 1) + ((\"at\" // 86400)::INT))", "yearly": "year(make_date(1970, 1, 1) + ((\"at\" // 86400)::INT))"}
    out = f"""WITH {fx.SNAPSHOTS}, k0 AS (SELECT id, "at" FROM snapshots ORDER BY "at" DESC, id DESC LIMIT {budgets["hourly"]}), l0 AS (SELECT * FROM snapshots WHERE id NOT IN (SELECT id FROM k0))"""
    for i, (tier, k) in enumerate(key.items(), 1):
        out += f""", r{i} AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY "at" DESC, id DESC) AS n FROM l{i - 1}), k{i} AS (SELECT id, "at" FROM r{i} WHERE n = 1 ORDER BY "at" DESC, id DESC LIMIT {budgets[tier]}), l{i} AS (SELECT id, "at" FROM l{i - 1} WHERE id NOT IN (SELECT id FROM k{i}))"""
    return out + " SELECT id, \"at\", 'hourly' AS tier FROM k0" + "".join(f" UNION ALL SELECT id, \"at\", '{x}' FROM k{i}" for i, x in enumerate(key, 1))


_BUDGETS = {"hourly": 24, "daily": 30, "weekly": 20, "monthly": 24, "yearly": 5}


@query(_retention_sql(_BUDGETS))
def w4_retention(spark: SparkSession, d: str) -> DataFrame:
    return retention(fx.snapshots(spark, d), **_BUDGETS)


#: Example tiers: name -> (latency ms, joules per GB, dollars per GB and month, egress per GB).
TIERS = {"nvme": (0.008, 0.5, 0.1, 0.0), "ssd": (0.1, 0.8, 0.06, 0.0), "hdd": (8.0, 2.5, 0.02, 0.0), "cloud": (50.0, 4.0, 0.01, 0.02), "tape": (300000.0, 0.2, 0.004, 0.02)}
#: Starting weights of recency, frequency, latency, energy, dollars and egress; decay a second.
WEIGHTS, DECAY = (1.0, 1.0, -0.05, -0.02, -0.01, -0.03), 1.0 / 86400


def tier_scores(extents: DataFrame, now: float, most: int) -> DataFrame:
    """extents (id, last, hits, gb) x tiers: score and rank. The five tiers are an array in the row, so nothing is joined."""
    rec = F.exp(-DECAY * F.greatest(F.lit(now) - F.col("last"), F.lit(0.0)))
    freq = F.ln(1.0 + F.col("hits")) / F.ln(F.lit(1.0 + most))
    hot, gb = rec * freq, F.col("gb")
    w = WEIGHTS
    one = lambda n, v: F.struct(F.lit(n).alias("tier"), (w[0] * rec + w[1] * freq + w[2] * hot * v[0] + w[3] * hot * v[1] * gb + w[4] * v[2] * gb + w[5] * v[3] * gb).alias("score"))
    return extents.select("id", F.posexplode(F.array(*[one(n, v) for n, v in TIERS.items()])).alias("pos", "s")).select("id", "pos", "s.tier", "s.score")


def _heat(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return t(spark, d, "part").select(p.alias("id"), ((p * 977) % 400000).cast("double").alias("last"), (p % 90).alias("hits"), (F.col("p_size") / 10.0).alias("gb"))


_TIERS_SQL = "tiers(pos, tier, lat, j, usd, eg) AS (VALUES " + ", ".join(f"({i}, '{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for i, (n, (a, b, c, e)) in enumerate(TIERS.items())) + ")"
_SCORES = f"""x AS (SELECT p_partkey AS id, exp(-(1.0::DOUBLE / 86400) * greatest(400000.0 - (p_partkey * 977) % 400000, 0)) AS rec, ln(1.0 + p_partkey % 90) / ln(90.0::DOUBLE) AS freq, p_size / 10.0::DOUBLE AS gb FROM part), {_TIERS_SQL},
sc AS (SELECT id, pos, tier, rec + freq - 0.05::DOUBLE * rec * freq * lat - 0.02::DOUBLE * rec * freq * j * gb - 0.01::DOUBLE * usd * gb - 0.03::DOUBLE * eg * gb AS score FROM x, tiers)"""


@query(f"WITH {_SCORES} SELECT id, tier, round(score, 6)::DOUBLE AS score FROM sc")
def w6_tier_score(spark: SparkSession, d: str) -> DataFrame:
    return tier_scores(_heat(spark, d), 400000.0, 89).select("id", "tier", F.round("score", 6).alias("score"))


@query(f"""WITH {_SCORES}, r AS (SELECT id, tier, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, CASE WHEN pos = id % 5 THEN -1 ELSE pos END) AS n FROM sc) SELECT id, tier FROM r WHERE n = 1""")
def t7_best_tier(spark: SparkSession, d: str) -> DataFrame:
    """The best score; the current tier (id mod 5 here) wins ties, then the first."""
    s = tier_scores(_heat(spark, d), 400000.0, 89)
    order = F.struct(F.round("score", 9), -F.when(F.col("pos") == F.col("id") % 5, -1).otherwise(F.col("pos")))
    return s.groupBy("id").agg(F.max_by("tier", order).alias("tier"))


@query(f"""WITH {fx.IO_OPS}, w AS (SELECT ns % 16 AS g, t // 86400 AS e, sum(bytes)::BIGINT % 3 AS best, (sum(latency_us)::BIGINT % 10) AS lead FROM io_ops GROUP BY 1, 2),
s AS (SELECT *, best <> 0 AND lead > 4 AS ok FROM w),
b AS (SELECT *, CASE WHEN ok AND lag(ok) OVER o AND lag(best) OVER o = best THEN 0 ELSE 1 END AS new FROM s WINDOW o AS (PARTITION BY g ORDER BY e)),
i AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY e) AS isl FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY g, isl ORDER BY e) AS k FROM i)
SELECT g, e, best FROM n WHERE ok AND k % 2 = 0""")
def w5_tier_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    """Migrate when the same better tier leads by the margin for two epochs; any other epoch, and a migration, starts over."""
    w = fx.io_ops(spark, d).groupBy((F.col("ns") % 16).alias("g"), F.floor(F.col("t") / 86400).alias("e")).agg((F.sum("bytes") % 3).alias("best"), (F.sum("latency_us") % 10).alias("lead"))

    def step(s: tuple, _: int, best: int, lead: int) -> tuple[tuple, tuple]:
        cand, streak = s
        if best == 0 or lead <= 4:
            return (-1, 0), (False,)
        streak = streak + 1 if cand == best else 1
        return ((-1, 0), (True,)) if streak >= 2 else ((best, streak), (False,))

    return scan_in_order(w, ["g"], ["e"], ["best", "lead"], (-1, 0), step, "fired boolean").filter("fired").select("g", "e", "best")


@query(f"""WITH {fx.IO_OPS}, w AS (SELECT ns % 40 AS g, t // 86400 AS e, count(*) AS n FROM io_ops GROUP BY 1, 2), l AS (SELECT g, list(e ORDER BY e) AS es FROM w GROUP BY g),
f AS (SELECT g, list_reduce(es, lambda a, e: CASE WHEN e - a[-1] >= 5 THEN list_append(a, e) ELSE a END, [-1000000::BIGINT]) AS kept FROM l)
SELECT g, unnest(kept[2:]) AS e FROM f""")
def w9_advisory_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Emit if five windows have passed since the last emission; greedy, so the last emission is carried, not the last row."""
    w = fx.io_ops(spark, d).select((F.col("ns") % 40).alias("g"), F.floor(F.col("t") / 86400).alias("e")).distinct()
    step = lambda s, e: ((e,), (True,)) if s[0] is None or e - s[0] >= 5 else (s, (False,))
    return scan_in_order(w, ["g"], ["e"], [], (None,), step, "kept boolean").filter("kept").select("g", "e")


@query(f"""WITH {fx.IO_OPS}, p AS (SELECT block % 25 AS a, lead(block % 25) OVER (PARTITION BY ns ORDER BY seq) AS b, ns, seq FROM io_ops), q AS (SELECT a, b, seq FROM p WHERE b IS NOT NULL),
l AS (SELECT a, list(b ORDER BY seq) AS bs FROM q GROUP BY a),
f AS (SELECT a, list_reduce(bs, lambda s, b: CASE WHEN s[1] = b THEN [s[1], s[2] + 1] WHEN s[2] <= 1 THEN [b, 1] ELSE [s[1], s[2] - 1] END, [-1::BIGINT, 0::BIGINT]) AS s FROM l)
SELECT a AS block, s[1] AS next, s[2] AS confidence, s[2] > 2 AS predicts FROM f""")
def w12_next_block(spark: SparkSession, d: str) -> DataFrame:
    """A majority vote per block on what follows it: agreement adds, disagreement takes away, an empty vote is replaced."""
    o = fx.io_ops(spark, d).withColumn("a", F.col("block") % 25)
    p = o.withColumn("b", F.lead("a").over(Window.partitionBy("ns").orderBy("seq"))).filter("b is not null")

    def vote(s: tuple, _: int, b: int) -> tuple:
        n, c = s
        return (n, c + 1) if n == b else (b, 1) if c <= 1 else (n, c - 1)

    out = fold_in_order(p, ["a"], ["seq"], ["b"], (-1, 0), vote, "next long, confidence long")
    return out.select(F.col("a").alias("block"), "next", "confidence", (F.col("confidence") > 2).alias("predicts"))


@query(f"WITH {fx.IO_OPS}, r AS (SELECT ns, block, seq, row_number() OVER (PARTITION BY ns, block ORDER BY seq) AS n FROM io_ops WHERE op = 'write') SELECT ns, block, seq FROM r WHERE n % 3 = 0")
def w13_punch_through(spark: SparkSession, d: str) -> DataFrame:
    """Every third rewrite of a cluster punches through and starts the count over."""
    n = F.row_number().over(Window.partitionBy("ns", "block").orderBy("seq"))
    return fx.io_ops(spark, d).filter("op = 'write'").withColumn("n", n).filter("n % 3 = 0").select("ns", "block", "seq")


@query("""WITH m AS (SELECT l_orderkey AS inode, l_linenumber AS n, 1 + l_discount * 10 AS ratio, l_quantity * 10485760 AS bps, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)
SELECT inode, CASE WHEN count(*) < 2 THEN 'probe' WHEN avg(ratio) < 1.2 THEN 'raw' WHEN avg(bps) < 262144000 THEN 'hot' ELSE 'warm' END AS tier FROM m WHERE k <= 2 GROUP BY inode""")
def w14_compression_tier(spark: SparkSession, d: str) -> DataFrame:
    """The first two measurements of a file pin its tier."""
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    m = t(spark, d, "lineitem").withColumn("k", k).filter("k <= 2").groupBy(F.col("l_orderkey").alias("inode")).agg(F.count("*").alias("n"), F.avg(1 + F.col("l_discount") * 10).alias("ratio"), F.avg(F.col("l_quantity") * 10485760).alias("bps"))
    return m.select("inode", F.when(F.col("n") < 2, "probe").when(F.col("ratio") < 1.2, "raw").when(F.col("bps") < 262144000, "hot").otherwise("warm").alias("tier"))


def token_bucket(rate_b: int, rate_o: int, burst_b: int, burst_o: int) -> tuple[tuple, Callable]:
    """Start state and step over rows (t seconds, seq, bytes): refill by time up to the burst, charge bytes and one operation or refuse."""

    def step(s: tuple, t_: int, _: int, size: int, *more: object) -> tuple[tuple, tuple]:
        b, o, at = s
        dt = max(t_ - at, 0)
        b, o = min(b + dt * rate_b, burst_b), min(o + dt * rate_o, burst_o)
        if ok := b >= size and o >= 1:
            b, o = b - size, o - 1
        return (b, o, max(t_, at)), (ok, b)

    return (burst_b, burst_o, 0), step


_BUCKET_SQL = f"""WITH {fx.IO_OPS}, l AS (SELECT ns, list({{'t': t, 'bytes': bytes, 'seq': seq, 'op': op}} ORDER BY t, seq) AS rs FROM io_ops GROUP BY ns),
f AS (SELECT ns, rs, list_reduce(rs, lambda a, r: list_append(a, {{'b': CASE WHEN least(a[-1].b + greatest(r.t - a[-1].at_, 0) * 1, 60000) >= r.bytes AND least(a[-1].o + greatest(r.t - a[-1].at_, 0) * 1, 10) >= 1 THEN least(a[-1].b + greatest(r.t - a[-1].at_, 0), 60000) - r.bytes ELSE least(a[-1].b + greatest(r.t - a[-1].at_, 0), 60000) END,
 'o': CASE WHEN least(a[-1].b + greatest(r.t - a[-1].at_, 0), 60000) >= r.bytes AND least(a[-1].o + greatest(r.t - a[-1].at_, 0), 10) >= 1 THEN least(a[-1].o + greatest(r.t - a[-1].at_, 0), 10) - 1 ELSE least(a[-1].o + greatest(r.t - a[-1].at_, 0), 10) END,
 'at_': greatest(r.t, a[-1].at_), 'ok': least(a[-1].b + greatest(r.t - a[-1].at_, 0), 60000) >= r.bytes AND least(a[-1].o + greatest(r.t - a[-1].at_, 0), 10) >= 1}}), [{{'b': 60000::BIGINT, 'o': 10::BIGINT, 'at_': 0::BIGINT, 'ok': false}}]) AS st FROM l),
z AS (SELECT ns, unnest(range(1, len(rs) + 1)) AS i, rs, st FROM f) """


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    start, step = token_bucket(1, 1, 60000, 10)
    return scan_in_order(fx.io_ops(spark, d), ["ns"], ["t", "seq"], ["bytes", "op"], start, step, "admitted boolean, tokens long")


@query(_BUCKET_SQL + "SELECT ns, rs[i].seq AS seq, st[i + 1].ok AS admitted, st[i + 1].b AS tokens FROM z")
def w15_token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _bucketed(spark, d).select("ns", "seq", "admitted", "tokens")


@query(_BUCKET_SQL + "SELECT ns, rs[i].seq AS seq, CASE WHEN ns % 9 = 0 THEN 'denied' WHEN st[i + 1].ok THEN 'admitted' WHEN rs[i].op = 'sync' THEN 'overrun' ELSE 'delayed' END AS admission FROM z")
def w18_shard_gate(spark: SparkSession, d: str) -> DataFrame:
    """Quota denial first, then the bucket; the realtime class (sync here) may overrun, others wait."""
    a = F.when(F.col("ns") % 9 == 0, "denied").when(F.col("admitted"), "admitted").when(F.col("op") == "sync", "overrun").otherwise("delayed")
    return _bucketed(spark, d).select("ns", "seq", a.alias("admission"))


@query("""WITH e AS (SELECT o_custkey AS ns, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * floor(o_totalprice / 100)::BIGINT AS d FROM orders),
s AS (SELECT *, sum(d) OVER (PARTITION BY ns ORDER BY seq ROWS UNBOUNDED PRECEDING) AS r FROM e), m AS (SELECT *, (r - least(0, min(r) OVER (PARTITION BY ns ORDER BY seq ROWS UNBOUNDED PRECEDING)))::BIGINT AS used FROM s),
c AS (SELECT *, used > 2000 AS over, coalesce(lag(used) OVER (PARTITION BY ns ORDER BY seq), 0) > 2000 AS was FROM m)
SELECT ns, seq, used, CASE WHEN over THEN max(CASE WHEN over AND NOT was THEN seq END) OVER (PARTITION BY ns ORDER BY seq ROWS UNBOUNDED PRECEDING) END AS soft_since FROM c""")
def w16_quota_charge(spark: SparkSession, d: str) -> DataFrame:
    """Usage never below zero; the soft limit's stamp is set at the crossing and cleared when back under it. Windows only."""
    k = F.col("o_orderkey")
    e = t(spark, d, "orders").select(F.col("o_custkey").alias("ns"), k.alias("seq"), (F.when(k % 3 == 0, -1).otherwise(1) * F.floor(F.col("o_totalprice") / 100)).alias("d"))
    w = Window.partitionBy("ns").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    m = e.withColumn("r", F.sum("d").over(upto)).withColumn("used", F.col("r") - F.least(F.lit(0), F.min("r").over(upto)))
    over, was = F.col("used") > 2000, F.coalesce(F.lag("used").over(w), F.lit(0)) > 2000
    crossed = m.withColumn("x", F.when(over & ~was, F.col("seq")))
    return crossed.select("ns", "seq", "used", F.when(over, F.max("x").over(upto)).alias("soft_since"))


@query("""WITH q AS (SELECT s_suppkey AS q, s_nationkey AS g, (s_suppkey * 37) % 1000 + 1 AS cost, s_suppkey % 4 + 1 AS weight FROM supplier), f AS (SELECT *, cost // weight AS finish FROM q)
SELECT g::BIGINT AS g, q, finish, row_number() OVER (PARTITION BY g ORDER BY finish, q) AS turn, max(finish) OVER (PARTITION BY g ORDER BY finish, q ROWS UNBOUNDED PRECEDING) AS vtime FROM f""")
def w17_fair_queue(spark: SparkSession, d: str) -> DataFrame:
    """One pending request a queue: turns by finish tag, ties to the lowest queue; virtual time is the greatest tag served."""
    s = F.col("s_suppkey")
    f = t(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("g"), s.alias("q"), F.floor(((s * 37) % 1000 + 1) / (s % 4 + 1)).alias("finish"))
    w = Window.partitionBy("g").orderBy("finish", "q")
    return f.select("g", "q", "finish", F.row_number().over(w).cast("long").alias("turn"), F.max("finish").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("vtime"))


@query(f"""WITH {fx.IO_OPS}, l AS (SELECT ns, list(t // 3600 - CASE WHEN seq % 5 = 0 THEN 40 ELSE 0 END ORDER BY seq) AS ts FROM io_ops GROUP BY ns),
f AS (SELECT ns, list_reduce(ts, lambda s, w: CASE WHEN w > s[1] THEN [w, 0] ELSE [s[1], least(s[2] + 1, 999999)] END, [0::BIGINT, 0::BIGINT]) AS s FROM l) SELECT ns, s[1] AS physical, s[2] AS logical FROM f""")
def w19_hybrid_clock(spark: SparkSession, d: str) -> DataFrame:
    """Physical time is the maximum seen; a reading not beyond it bumps the logical part, up to its cap."""
    o = fx.io_ops(spark, d).withColumn("w", F.floor(F.col("t") / 3600) - F.when(F.col("seq") % 5 == 0, 40).otherwise(0))
    step = lambda s, _, w: (w, 0) if w > s[0] else (s[0], min(s[1] + 1, 999999))
    return fold_in_order(o, ["ns"], ["seq"], ["w"], (0, 0), step, "physical long, logical long")
