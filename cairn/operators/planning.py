"""Ranking and planning: collection plans, cleaning order, free runs, rebalancing, zone and band plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.intervals import bucketed
from cairn.operators.ordered import fold_in_order, scan_in_order
from cairn.plans.registry import query
from cairn.shared import stash, workspace
from cairn.sources import fixtures as fx
from cairn.sources.fixtures import t

#: Wear in basis points per 100 cycles; most segments in a plan.
WEAR_BPS, PLAN_SEGMENTS = 8, 12


def gc_scores(segments: DataFrame, half_life_s: int, aggressive: bool) -> DataFrame:
    """Benefit over cost of evacuating each segment with something to gain; integers as decimals, the quotient floored."""
    free = F.col("total") - F.col("live")
    big = lambda c: c.cast("decimal(38,0)")
    if aggressive:
        score = free
    else:
        unit = 1 << 32
        age = F.expr(f"cast(age_s as decimal(20,0)) * {unit} div {half_life_s}") + unit
        benefit = F.floor(big(free) * age / unit)
        wear = F.expr(f"cycles * {WEAR_BPS} div 100")
        cost = F.floor(2 * F.col("live") * (unit + F.expr(f"cast({unit} as bigint)") * wear / 10000) / unit)
        score = F.when(cost == 0, F.lit((1 << 63) - 1)).otherwise(F.floor(benefit.cast("double") * (1 << 20) / cost).cast("long"))
    return segments.filter(free > 0).withColumn("freeable", free).withColumn("score", score)


def gc_plan(segments: DataFrame, total: int, free: int, half_life_s: int) -> DataFrame:
    """Nothing at 25 % free or more; below 10 % by freeable bytes alone; ties to the lower id; at most twelve segments."""
    pct = free * 10000 // total // 100 if total else 100
    s = gc_scores(segments, half_life_s, pct < 10)
    if pct >= 25:
        s = s.limit(0)
    return s.orderBy(F.desc("score"), "segment").limit(PLAN_SEGMENTS).withColumn("urgency", F.lit("aggressive" if pct < 10 else "background"))


@query(f"WITH {fx.SEGMENTS} SELECT segment, total - live AS freeable, 2 * live AS copy_bytes, 'aggressive' AS urgency FROM segments WHERE total > live ORDER BY total - live DESC, segment LIMIT 12")
def t1_gc_plan(spark: SparkSession, d: str) -> DataFrame:
    """Nine percent free: the aggressive plan. The background score is tested against a plain fold."""
    return gc_plan(fx.segments(spark, d), 100, 9, 86400).select("segment", "freeable", (2 * F.col("live")).alias("copy_bytes"), "urgency")


@query(f"WITH {fx.SEGMENTS}, u AS (SELECT segment, CASE WHEN total > 0 THEN live / total ELSE 0 END AS u, age_s FROM segments) SELECT segment, round((1 - u) * age_s / (1 + u), 3)::DOUBLE AS score FROM u ORDER BY score DESC, segment")
def t2_cleaner_ranking(spark: SparkSession, d: str) -> DataFrame:
    u = F.when(F.col("total") > 0, F.col("live") / F.col("total")).otherwise(0.0)
    return fx.segments(spark, d).select("segment", F.round((1 - u) * F.col("age_s") / (1 + u), 3).alias("score")).orderBy(F.desc("score"), "segment")


@query(f"WITH {fx.FREE_RUNS} SELECT start, len FROM free_runs ORDER BY len DESC, start LIMIT 10")
def t4_largest_free_runs(spark: SparkSession, d: str) -> DataFrame:
    return fx.free_runs(spark, d).orderBy(F.desc("len"), "start").limit(10)


#: How far a band drains a device, in basis points (healthy, watch, degraded, failing).
DRAIN_BPS = [0, 2500, 5000, 10000]


def rebalance_targets(devices: DataFrame) -> DataFrame:
    """Each device's share of what the pool uses, less by its health; leaving devices target nothing. The totals are one row."""
    pool = devices.agg(F.sum("used").alias("pool_used"), F.sum(F.when(~F.col("leaving"), F.col("capacity")).otherwise(0)).alias("pool_cap"))
    x = devices.crossJoin(F.broadcast(pool))
    keep = F.element_at(F.array(*[F.lit(10000 - b) for b in DRAIN_BPS]), (F.col("band") + 1).cast("int"))
    share = F.expr("cast(capacity as decimal(19,0)) * pool_used div pool_cap")
    target = F.when(F.col("leaving"), 0).when((F.col("pool_cap") == 0) | (F.col("capacity") == 0), F.col("used")).otherwise(F.floor(share * keep / 10000))
    return x.withColumn("target", target.cast("long"))


def running_sum(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with the sum of `value` up to and with each one in a global order: sums by range first, then within the ranges."""
    ranged = stash(rows.repartitionByRange(*order).withColumn("_r", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = ranged.groupBy("_r").agg(F.sum(value).alias("_n")).select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("_in", F.sum(value).over(inside)).join(F.broadcast(sums), "_r").withColumn(name, F.col("_before") + F.col("_in")).drop("_r", "_in", "_before")


def rebalance_moves(targets: DataFrame, budget: int) -> DataFrame:
    """Greedy two-pointer moves, as the overlaps of two running sums cut at the budget: leaving sources first, then the fullest; emptiest destinations first.

    What sources and destinations cover is disjoint on either side, so cut at fixed bounds both have few pieces, and overlaps are an equi join.
    """
    gap = F.col("used") - F.col("target")
    with workspace(targets.sparkSession):
        targets = stash(targets.filter("capacity > 0"), "targets")
        src = targets.filter(gap > 0).select("device", gap.alias("n"), "leaving")
        dst = targets.filter((gap < 0) & ~F.col("leaving")).select("device", (-gap).alias("n"))
        s = running_sum(src, [F.desc("leaving"), F.desc("n"), F.col("device")], "n", "hi").select(F.col("device").alias("from"), (F.col("hi") - F.col("n")).alias("lo_s"), F.least("hi", F.lit(budget)).alias("hi_s"))
        e = running_sum(dst, [F.desc("n"), F.col("device")], "n", "hi").select(F.col("device").alias("to"), (F.col("hi") - F.col("n")).alias("lo_d"), F.least("hi", F.lit(budget)).alias("hi_d"))
        width = max(1, budget // 1024)
        s = bucketed(s.withColumn("n", F.col("hi_s") - F.col("lo_s")), "lo_s", "n", width).drop("n")
        e = bucketed(e.withColumn("n", F.col("hi_d") - F.col("lo_d")), "lo_d", "n", width).drop("n")
        j = s.join(e, "_b")
        j = j.filter((F.col("lo_s") < F.col("hi_d")) & (F.col("lo_d") < F.col("hi_s")) & (F.col("_b") == F.floor(F.greatest("lo_s", "lo_d") / width)))
        n = F.least("hi_s", "hi_d") - F.greatest("lo_s", "lo_d")
        return stash(j.select("from", "to", n.alias("bytes")).filter("bytes > 0"), "moves", keep=True)


_TARGETS = f"""{fx.DEVICES}, pool AS (SELECT sum(used)::BIGINT AS u, sum(capacity) FILTER (NOT leaving)::BIGINT AS c FROM devices),
tg AS (SELECT d.*, CASE WHEN leaving THEN 0 ELSE ((capacity::HUGEINT * u // c) * [10000, 7500, 5000, 0][band + 1] // 10000)::BIGINT END AS target FROM devices d, pool)"""


@query(f"WITH {_TARGETS} SELECT device, used, target FROM tg")
def t5_rebalance_targets(spark: SparkSession, d: str) -> DataFrame:
    return rebalance_targets(fx.devices(spark, d)).select("device", "used", "target")


@query(f"""WITH {_TARGETS}, s AS (SELECT device, used - target AS n, sum(used - target) OVER (ORDER BY leaving DESC, used - target DESC, device ROWS UNBOUNDED PRECEDING) AS hi FROM tg WHERE capacity > 0 AND used > target),
e AS (SELECT device, target - used AS n, sum(target - used) OVER (ORDER BY target - used DESC, device ROWS UNBOUNDED PRECEDING) AS hi FROM tg WHERE capacity > 0 AND used < target AND NOT leaving)
SELECT s.device AS "from", e.device AS "to", (least(s.hi, e.hi, 200000) - greatest(s.hi - s.n, e.hi - e.n))::BIGINT AS bytes FROM s, e WHERE least(s.hi, e.hi, 200000) > greatest(s.hi - s.n, e.hi - e.n)""")
def t5_rebalance_moves(spark: SparkSession, d: str) -> DataFrame:
    return rebalance_moves(rebalance_targets(fx.devices(spark, d)), 200000)


@query(f"""WITH {_TARGETS} SELECT device, CASE WHEN leaving THEN used = 0 ELSE abs(used - target) <= greatest(capacity // 100, 1) END AS balanced FROM tg""")
def t11_pool_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The check that ends a rebalance loop, by device."""
    s = rebalance_targets(fx.devices(spark, d))
    return s.select("device", _balanced(s).alias("balanced"))


def until_settled(state: DataFrame, step: Callable[[DataFrame], DataFrame], settled: Callable[[DataFrame], bool], rounds: int) -> tuple[DataFrame, int]:
    """Driver control of a planning loop: each round's state is a table; the last state and the rounds that were needed."""
    for done in range(rounds):
        if settled(state):
            return state, done
        state = stash(step(state), "round", keep=True)
    return state, rounds


def _balanced(state: DataFrame) -> Column:
    slack = F.greatest(F.expr("capacity div 100"), F.lit(1))
    return F.when(F.col("leaving"), F.col("used") == 0).otherwise(F.abs(F.col("used") - F.col("target")) <= slack)


def rebalance_loop(devices: DataFrame, budget: int, rounds: int) -> tuple[DataFrame, int]:
    """Targets are set anew each round, at most `budget` moves, and devices are as full as the moves leave them, until all are balanced or nothing moves."""
    settled = lambda s: not rebalance_targets(s.drop("moved")).filter(~_balanced(s)).limit(1).count() or ("moved" in s.columns and not s.filter("moved > 0").limit(1).count())

    def step(s: DataFrame) -> DataFrame:
        s = s.drop("moved")
        m = rebalance_moves(rebalance_targets(s), budget)
        change = m.select(F.col("from").alias("_d"), (-F.col("bytes")).alias("x")).unionByName(m.select(F.col("to").alias("_d"), F.col("bytes").alias("x"))).groupBy("_d").agg(F.sum("x").alias("x"), F.sum(F.abs("x")).alias("moved"))
        out = s.join(change, F.col("device") == F.col("_d"), "left").withColumn("used", F.col("used") + F.coalesce("x", F.lit(0)))
        return out.select(*s.columns, F.coalesce("moved", F.lit(0)).alias("moved"))

    return until_settled(devices, step, settled, rounds)


@query()
def t11_rebalance_loop(spark: SparkSession, d: str) -> DataFrame:
    """The pool after at most eight rounds, each with a budget of a million: what every device holds, and how many rounds it took."""
    out, rounds = rebalance_loop(fx.devices(spark, d), 1_000_000, 8)
    return out.select("device", "used", F.lit(rounds).cast("long").alias("rounds"))


def gc_loop(segments: DataFrame, free: int, total: int, half_life_s: int, rounds: int) -> tuple[DataFrame, int]:
    """Collect the planned segments and plan again, until a quarter of the space is free, nothing is left to gain, or the rounds are over.

    A collected segment's live bytes go to one new segment a round; `free` is what the pool has beyond its segments.
    """

    def spare(s: DataFrame) -> int:
        return total - int(s.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]) + free

    def settled(s: DataFrame) -> bool:
        return spare(s) * 100 >= total * 25 or not s.filter("total > live").limit(1).count()

    def step(s: DataFrame) -> DataFrame:
        plan = gc_plan(s, total, max(0, spare(s)), half_life_s).select("segment")  # at most twelve rows
        taken = s.join(F.broadcast(plan), "segment", "left_semi")
        new = taken.agg(F.min("segment").alias("segment"), F.sum("live").alias("total"), F.sum("live").alias("live"), F.lit(0).cast("long").alias("age_s"), (F.max("cycles") + 1).alias("cycles")).filter("total is not null")
        return s.join(F.broadcast(plan), "segment", "left_anti").select("segment", "total", "live", "age_s", "cycles").unionByName(new.select(*[F.col(c).cast(s.schema[c].dataType).alias(c) for c in ("segment", "total", "live", "age_s", "cycles")]))

    return until_settled(segments.select("segment", "total", "live", "age_s", "cycles"), step, settled, rounds)


@query()
def t11_gc_loop(spark: SparkSession, d: str) -> DataFrame:
    """What six rounds of collection leave of the segments."""
    s = fx.segments(spark, d)
    total = int(s.agg(F.sum("total")).first()[0])
    out, rounds = gc_loop(s, total // 20, total, 86400, 6)
    return out.select("segment", "total", "live", F.lit(rounds).cast("long").alias("rounds"))


@query("WITH b AS (SELECT s_suppkey AS band, 1000 AS cap, (s_suppkey * 53) % 1000 AS live, s_suppkey % 3 AS wp FROM supplier) SELECT band, live FROM b WHERE (cap - live) * 2 >= cap AND wp > 0 ORDER BY band")
def t6_smr_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    b = t(spark, d, "supplier").select(s.alias("band"), ((s * 53) % 1000).alias("live"), (s % 3).alias("wp"))
    return b.filter((1000 - F.col("live")) * 2 >= 1000).filter("wp > 0").select("band", "live").orderBy("band")


@query(f"WITH {fx.IO_OPS}, x AS (SELECT ns % 5 AS pool, ns, sum(bytes)::BIGINT AS dirty FROM io_ops WHERE op = 'write' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY dirty DESC, ns DESC) AS n FROM x) SELECT pool, ns AS inode, dirty FROM r WHERE n = 1")
def t8_largest_dirty(spark: SparkSession, d: str) -> DataFrame:
    x = fx.io_ops(spark, d).filter("op = 'write'").groupBy((F.col("ns") % 5).alias("pool"), "ns").agg(F.sum("bytes").alias("dirty"))
    return x.groupBy("pool").agg(F.max(F.struct("dirty", "ns")).alias("m")).select("pool", F.col("m.ns").alias("inode"), "m.dirty")


def plan_zones(appends: pd.DataFrame, zones: int, capacity: int) -> pd.DataFrame:
    """Appends (file, seq, len) of one device, in order. A file stays in its zone until that is 85 % full or too small,
    then takes the lowest empty zone, else the lowest one with room, whatever its fill; -1: no zone fits."""
    wp, home, out = [0] * zones, {}, []
    fits = lambda z, n: wp[z] * 10000 // capacity < 8500 and capacity - wp[z] >= n
    for file, n in zip(appends["file"], appends["len"], strict=True):
        z = home.get(file)
        if z is None or not fits(z, n):
            z = next((i for i in range(zones) if wp[i] == 0 and fits(i, n)), None)
            if z is None:
                z = next((i for i in range(zones) if 0 < capacity - wp[i] >= n), None)
        if z is None:
            out.append((-1, -1))
            continue
        home[file] = z
        out.append((z, z * capacity + wp[z]))
        wp[z] += n
    return appends.assign(zone=[z for z, _ in out], offset=[o for _, o in out])


def plan_bands(appends: pd.DataFrame, bands: int, capacity: int) -> pd.DataFrame:
    """A file keeps its band while it fits; a new one gets the lowest band that no file has."""
    wp, home, out = [0] * bands, {}, []
    for file, n in zip(appends["file"], appends["len"], strict=True):
        b = home.get(file)
        if b is None or capacity - wp[b] < n:
            b = next((i for i in range(bands) if i not in home.values() and capacity - wp[i] >= n), None)
        if b is None:
            out.append((-1, -1))
            continue
        home[file] = b
        out.append((b, b * capacity + wp[b]))
        wp[b] += n
    return appends.assign(zone=[b for b, _ in out], offset=[o for _, o in out])


def _appends(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select((F.col("l_suppkey") % 25).alias("device"), (F.col("l_orderkey") % 7).alias("file"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("seq"), F.col("l_quantity").cast("long").alias("len"))


def _planned(rows: DataFrame, plan: Callable[[pd.DataFrame, int, int], pd.DataFrame], n: int, capacity: int) -> DataFrame:
    """One device's appends are sequential by nature; devices are independent groups."""
    ordered = rows.withColumn("i", F.row_number().over(Window.partitionBy("device").orderBy("seq")).cast("long")).drop("seq")
    run = lambda pdf: plan(pdf.sort_values("i"), n, capacity)[["device", "i", "file", "len", "zone", "offset"]]
    return ordered.groupBy("device").applyInPandas(run, "device long, i long, file long, len long, zone long, offset long")


@query()
def w20_zone_append(spark: SparkSession, d: str) -> DataFrame:
    return _planned(_appends(spark, d), plan_zones, 24, 500)


@query()
def w21_band_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _planned(_appends(spark, d), plan_bands, 12, 900)


@query()
def w7_online_weights(spark: SparkSession, d: str) -> DataFrame:
    """Gradient steps on the placement weights, clamped to +-50, in event order. The reference keeps one set of weights for a node; here a node is a group of sixteen namespaces."""
    o = fx.io_ops(spark, d).select((F.col("ns") % 16).alias("g"), "seq", (F.col("latency_us") / 10000.0).alias("cost"), (F.col("block") / 50.0).alias("x"))

    def step(s: tuple, _: int, cost: float, x: float) -> tuple:
        w0, w1 = s
        err = cost + w0 + w1 * x
        return min(max(w0 - 0.01 * err, -50.0), 50.0), min(max(w1 - 0.01 * err * x, -50.0), 50.0)

    out = fold_in_order(o, ["g"], ["seq"], ["cost", "x"], (1.0, -0.05), step, "w0 double, w1 double")
    return out.select("g", F.round("w0", 9).alias("w0"), F.round("w1", 9).alias("w1"))


def victims(segments: DataFrame, threshold: float) -> DataFrame:
    """Segments below the live threshold without parity, in the order in which a collector takes them: least live fraction first."""
    u = F.when(F.col("total") > 0, F.col("live") / F.col("total")).otherwise(0.0)
    return segments.withColumn("u", u).filter(F.col("u") < threshold).orderBy("u", "segment")


@query(f"WITH {fx.SEGMENTS} SELECT segment, round(live / total, 9)::DOUBLE AS u, total - live AS reclaimed FROM segments WHERE live / total < 0.65 ORDER BY live / total, segment")
def t3_gc_victims(spark: SparkSession, d: str) -> DataFrame:
    return victims(fx.segments(spark, d), 0.65).select("segment", F.round("u", 9).alias("u"), (F.col("total") - F.col("live")).alias("reclaimed"))


@query(f"""WITH {fx.SNAPSHOTS}, k AS (SELECT id FROM snapshots ORDER BY "at" DESC, id DESC LIMIT 100) SELECT count(*)::BIGINT AS expired, min(id) AS first_expired FROM snapshots WHERE id NOT IN (SELECT id FROM k)""")
def t10_retention_step(spark: SparkSession, d: str) -> DataFrame:
    """What one pass of the retention daemon would delete: all but the kept, as an anti join."""
    from cairn.operators.ordered import retention

    s = fx.snapshots(spark, d)
    gone = s.join(retention(s, 100, 0, 0, 0, 0).select("id"), "id", "left_anti")
    return gone.agg(F.count("*").alias("expired"), F.min("id").alias("first_expired"))


@query(f"""WITH {fx.IO_OPS}, c AS (SELECT *, sum(bytes) OVER (PARTITION BY ns ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY ns ORDER BY seq) AS n FROM io_ops WHERE op = 'write'),
l AS (SELECT ns, list({{'seq': seq, 'b': bytes}} ORDER BY seq) AS rs FROM io_ops WHERE op = 'write' GROUP BY ns),
f AS (SELECT ns, list_reduce(rs, lambda a, r: list_append(a, CASE WHEN a[-1].fl THEN {{'w': a[-1].w + 1, 'b': r.b, 'n': 1::BIGINT, 'fl': r.b >= 40000 OR 1 >= 8}} ELSE {{'w': a[-1].w, 'b': a[-1].b + r.b, 'n': a[-1].n + 1, 'fl': a[-1].b + r.b >= 40000 OR a[-1].n + 1 >= 8}} END), [{{'w': 0::BIGINT, 'b': 0::BIGINT, 'n': 0::BIGINT, 'fl': false}}]) AS st FROM l),
z AS (SELECT ns, unnest(range(1, len(st))) AS i, st FROM f)
SELECT ns, st[i + 1].w AS "window", count(*)::BIGINT AS records, max(st[i + 1].b) AS bytes, bool_or(st[i + 1].fl) AS closed FROM z GROUP BY ns, st[i + 1].w""")
def r2_commit_windows(spark: SparkSession, d: str) -> DataFrame:
    """A window is ready at a byte or a record budget, whichever comes first; the next record opens the next one."""

    def step(s: tuple, _: int, size: int) -> tuple[tuple, tuple]:
        w, b, n, full = s
        w, b, n = (w + 1, size, 1) if full else (w, b + size, n + 1)
        full = b >= 40000 or n >= 8
        return (w, b, n, full), (w, b, full)

    st = scan_in_order(fx.io_ops(spark, d).filter("op = 'write'"), ["ns"], ["seq"], ["bytes"], (0, 0, 0, False), step, "window long, upto long, closed boolean")
    return st.groupBy("ns", "window").agg(F.count("*").alias("records"), F.max("upto").alias("bytes"), F.bool_or("closed").alias("closed"))


@query("WITH c AS (SELECT user_id AS ns, max(event_id) AS upto FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT e.user_id AS ns, count(*)::BIGINT AS durable FROM events e JOIN c ON e.user_id = c.ns AND e.event_id <= c.upto WHERE event_type <> 'purchase' GROUP BY 1")
def r3_replay_state(spark: SparkSession, d: str) -> DataFrame:
    """Entries at or before the last commit are durable; control records are skipped."""
    e = t(spark, d, "events").select(F.col("user_id").alias("ns"), "event_id", "event_type")
    c = e.filter("event_type = 'purchase'").groupBy("ns").agg(F.max("event_id").alias("upto"))
    return e.filter("event_type <> 'purchase'").join(c, "ns").filter("event_id <= upto").groupBy("ns").agg(F.count("*").alias("durable"))


@query("SELECT user_id % 4 AS shard, event_id // 100 AS batch, count(*)::BIGINT AS records FROM events WHERE event_id < 880 GROUP BY 1, 2")
def r5_torn_tail(spark: SparkSession, d: str) -> DataFrame:
    """What follows a tear is dropped and never reordered: the rule of the journal replay, by batch."""
    from cairn.operators.scans import replay_journal

    e = t(spark, d, "events").select("event_id", "user_id")
    good = replay_journal(e, "event_id", F.col("event_id") != 880)
    return good.groupBy((F.col("user_id") % 4).alias("shard"), F.floor(F.col("event_id") / 100).alias("batch")).agg(F.count("*").alias("records"))


@query("""WITH g AS (SELECT user_id % 30 AS copyset, event_id AS generation, event_id % 7 <> 0 AS valid FROM events) SELECT copyset, coalesce(max(generation) FILTER (valid), -1) AS generation FROM g GROUP BY 1""")
def r11_superblock_copy(spark: SparkSession, d: str) -> DataFrame:
    """Recovery starts from the valid copy of the highest generation."""
    e = t(spark, d, "events").select((F.col("user_id") % 30).alias("copyset"), F.col("event_id").alias("generation"))
    return e.groupBy("copyset").agg(F.coalesce(F.max(F.when(F.col("generation") % 7 != 0, F.col("generation"))), F.lit(-1)).alias("generation"))


@query("SELECT user_id % 10 AS ns, epoch(date_trunc('hour', ts))::BIGINT AS start, count(*)::BIGINT AS ops FROM events GROUP BY 1, 2")
def r8_tumbling_addition(spark: SparkSession, d: str) -> DataFrame:
    """An addition: event-time windows (the reference only has windows that its caller makes)."""
    w = t(spark, d, "events").groupBy((F.col("user_id") % 10).alias("ns"), F.window("ts", "1 hour")).agg(F.count("*").alias("ops"))
    return w.select("ns", fx.epoch_s("window.start").alias("start"), "ops")
