"""Interval operators: point-in-interval and coverage joins, differences, coalescing, coverage counts.

Joins between points and intervals go through fixed-width buckets: both sides become equi-join keys, so the plan
is a hash or sort-merge join with a residual condition and never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.plans.registry import query
from cairn.sources import fixtures as fx
from cairn.sources.fixtures import t


def bucketed(intervals: DataFrame, start: str, length: str, width: int, name: str = "_b") -> DataFrame:
    """Intervals repeated once for every bucket that they touch; empty ones vanish."""
    last = F.floor((F.col(start) + F.col(length) - 1) / width)
    return intervals.filter(F.col(length) > 0).withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), last)))


def point_in_interval(points: DataFrame, point: str, intervals: DataFrame, start: str, length: str, *, width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Every point with every interval that holds it, by bucketed equi join."""
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    j = p.join(bucketed(intervals, start, length, width), [*on, "_b"])
    return j.filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + F.col(length))).drop("_b")


@query(f"""WITH {fx.EXTENTS}, p AS (SELECT l_orderkey AS file, l_linenumber * 64 + l_suppkey % 40 AS b, l_linenumber AS n FROM lineitem),
j AS (SELECT p.file, p.b, physical + (b - logical) AS phys, logical FROM p JOIN extents e ON p.file = e.file AND b >= logical AND b < logical + length)
SELECT file, b, min(phys)::BIGINT AS physical FROM j GROUP BY file, b""")
def j7_block_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Logical to physical block; of overlapping extents the least address."""
    p = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 64 + F.col("l_suppkey") % 40).alias("b")).distinct()
    j = point_in_interval(p, "b", fx.extents(spark, d), "logical", "length", width=64, on=("file",))
    return j.groupBy("file", "b").agg(F.min(F.col("physical") + F.col("b") - F.col("logical")).alias("physical"))


def remove_range(logical: Column, physical: Column, length: Column, lo: Column, hi: Column) -> Column:
    """What is left of an extent without [lo, hi): none, one or two pieces of (logical, physical, length)."""
    piece = lambda at, n: F.struct(at.alias("logical"), (physical + (at - logical)).alias("physical"), n.alias("length"))
    end = logical + length
    left = piece(logical, F.least(lo, end) - logical)
    from_ = F.greatest(hi, logical)
    right = piece(from_, end - from_)
    whole = F.array(piece(logical, length))
    return F.when((hi <= lo) | (hi <= logical) | (lo >= end), whole).otherwise(F.filter(F.array(left, right), lambda x: x["length"] > 0))


_PUNCH = """WITH {e}, x AS (SELECT file, logical, physical, length, {lo} AS lo, {hi} AS hi FROM extents),
p AS (SELECT file, logical, physical, length FROM x WHERE hi <= logical OR lo >= logical + length OR hi <= lo
 UNION ALL SELECT file, logical, physical, lo - logical FROM x WHERE NOT (hi <= logical OR lo >= logical + length OR hi <= lo) AND lo > logical
 UNION ALL SELECT file, greatest(hi, logical), physical + greatest(hi, logical) - logical, logical + length - greatest(hi, logical) FROM x WHERE NOT (hi <= logical OR lo >= logical + length OR hi <= lo) AND hi < logical + length)
SELECT file, logical::BIGINT AS logical, physical::BIGINT AS physical, length::BIGINT AS length FROM p"""


def _punched(spark: SparkSession, d: str, lo: Column, hi: Column) -> DataFrame:
    x = fx.extents(spark, d)
    c = F.col
    return x.select("file", F.explode(remove_range(c("logical"), c("physical"), c("length"), lo, hi)).alias("p")).select("file", "p.logical", "p.physical", "p.length")


@query(_PUNCH.format(e=fx.EXTENTS, lo="70", hi="150"))
def j8_interval_difference(spark: SparkSession, d: str) -> DataFrame:
    return _punched(spark, d, F.lit(70).cast("long"), F.lit(150).cast("long"))


@query(_PUNCH.format(e=fx.EXTENTS, lo="140", hi="1099511627776"))
def s26_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Truncation removes everything past the new size."""
    return _punched(spark, d, F.lit(140).cast("long"), F.lit(1 << 40))


def coverage_runs(intervals: DataFrame, start: str, length: str, key: str, delta: Column | None = None) -> DataFrame:
    """Disjoint runs (key, start, end, count) of an interval multiset by an event sweep.

    Equal places are summed first, in partial aggregates. The running sum goes by key (volume, device, region), and so
    does the parallelism; equal neighbours are merged.
    """
    one = F.lit(1) if delta is None else delta
    on = intervals.filter(F.col(length) > 0)
    ends = on.select(key, F.explode(F.array(F.struct(F.col(start).alias("x"), one.alias("v")), F.struct((F.col(start) + F.col(length)).alias("x"), (-one).alias("v")))).alias("e"))
    steps = ends.groupBy(key, F.col("e.x").alias("x")).agg(F.sum("e.v").cast("long").alias("v")).filter("v <> 0")
    w = Window.partitionBy(key).orderBy("x")
    runs = steps.select(key, F.col("x").alias("start"), F.lead("x").over(w).alias("end"), F.sum("v").over(w).alias("count"))
    return runs.filter("count <> 0 and end is not null")


_RUNS = """{e}, ev AS (SELECT file % 50 AS region, physical AS x, 1 AS v FROM extents UNION ALL SELECT file % 50, physical + length, -1 FROM extents),
st AS (SELECT region, x, sum(v) AS v FROM ev GROUP BY 1, 2 HAVING sum(v) <> 0),
runs AS (SELECT region, x AS start, lead(x) OVER (PARTITION BY region ORDER BY x) AS "end", sum(v) OVER (PARTITION BY region ORDER BY x)::BIGINT AS count FROM st)"""


@query(f"""WITH {_RUNS.format(e=fx.EXTENTS)} SELECT region, start, "end", count FROM runs WHERE count <> 0""")
def a9_coverage_pins(spark: SparkSession, d: str) -> DataFrame:
    return coverage_runs(fx.extents(spark, d).withColumn("region", F.col("file") % 50), "physical", "length", "region")


def fully_covered(asked: DataFrame, runs: DataFrame, key: str, width: int) -> DataFrame:
    """asked (id, key, s, len) -> covered: whether disjoint runs cover all of it; an empty range is not covered."""
    a = bucketed(asked, "s", "len", width)
    r = bucketed(runs.withColumn("n", F.col("end") - F.col("start")), "start", "n", width)
    hit = a.join(r, [key, "_b"]).filter("start < s + len and end > s")
    hit = hit.dropDuplicates(["id", key, "start"])  # a pair that shares several buckets counts once
    part = hit.groupBy("id").agg(F.sum(F.least(F.col("end"), F.col("s") + F.col("len")) - F.greatest("start", "s")).alias("got"))
    return asked.join(part, "id", "left").select("id", (F.coalesce("got", F.lit(0)) >= F.col("len")).alias("full"), "len").select("id", (F.col("full") & (F.col("len") > 0)).alias("covered"))


@query(f"""WITH {_RUNS.format(e=fx.EXTENTS)}, q AS (SELECT p_partkey AS id, p_partkey % 50 AS region, p_partkey * 64 AS s, p_size % 8 AS len FROM part),
g AS (SELECT id, sum(least("end", s + len) - greatest(start, s)) AS got FROM q JOIN runs r ON q.region = r.region AND r.start < s + len AND r."end" > s AND r.count <> 0 GROUP BY id)
SELECT q.id, len > 0 AND coalesce(got, 0) >= len AS covered FROM q LEFT JOIN g USING (id)""")
def j9_range_covered(spark: SparkSession, d: str) -> DataFrame:
    runs = coverage_runs(fx.extents(spark, d).withColumn("region", F.col("file") % 50), "physical", "length", "region")
    q = t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("region"), (F.col("p_partkey") * 64).alias("s"), (F.col("p_size") % 8).cast("long").alias("len"))
    return fully_covered(q, runs, "region", 256)


def coalesce_extents(extents: DataFrame, key: str, start: str, length: str) -> DataFrame:
    """Merge strictly adjacent runs within each key."""
    w = Window.partitionBy(key).orderBy(start, length)
    x = extents.withColumn("_new", (F.coalesce(F.lag(F.col(start) + F.col(length)).over(w) != F.col(start), F.lit(True))).cast("int"))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "_run").agg(F.min(start).alias(start), F.sum(length).alias(length)).drop("_run")


@query("""WITH e AS (SELECT p_partkey % 20 AS g, p_partkey * 10 AS start, CASE WHEN p_size % 3 = 0 THEN 200 ELSE p_size END::BIGINT AS length FROM part),
n AS (SELECT *, CASE WHEN lag(start + length) OVER (PARTITION BY g ORDER BY start) = start THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY start) AS run FROM n)
SELECT g, min(start) AS start, sum(length)::BIGINT AS length FROM r GROUP BY g, run""")
def w10_extent_coalesce(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "part").select((F.col("p_partkey") % 20).alias("g"), (F.col("p_partkey") * 10).alias("start"), F.when(F.col("p_size") % 3 == 0, 200).otherwise(F.col("p_size")).cast("long").alias("length"))
    return coalesce_extents(e, "g", "start", "length")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS g, (l_partkey * 31) % 4000 AS start, (l_quantity)::BIGINT AS n FROM lineitem),
m AS (SELECT *, max(start + n) OVER (PARTITION BY g ORDER BY start, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM e),
gaps AS (SELECT g, coalesce(upto, 0) AS start, start AS stop FROM m WHERE start > coalesce(upto, 0) UNION ALL SELECT g, max(start + n), 5000 FROM e GROUP BY g HAVING max(start + n) < 5000)
SELECT g AS segment, start::BIGINT AS start, (stop - start)::BIGINT AS length FROM gaps""")
def w11_free_list(spark: SparkSession, d: str) -> DataFrame:
    """The complement of the live extents inside each segment [0, 5000)."""
    e = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("segment"), ((F.col("l_partkey") * 31) % 4000).alias("s"), F.col("l_quantity").cast("long").alias("n")).distinct()
    w = Window.partitionBy("segment").orderBy("s", "n").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.max(F.col("s") + F.col("n")).over(w), F.lit(0))
    gaps = e.select("segment", upto.alias("start"), F.col("s").alias("stop")).filter("stop > start")
    tail = e.groupBy("segment").agg(F.max(F.col("s") + F.col("n")).alias("start")).select("segment", "start", F.lit(5000).cast("long").alias("stop")).filter("stop > start")
    return gaps.unionByName(tail).select("segment", "start", (F.col("stop") - F.col("start")).alias("length"))


@query(f"WITH {fx.EXTENTS} SELECT file, sum(length)::BIGINT AS physical_blocks, max(logical + length) AS allocated FROM extents GROUP BY file")
def a27_physical_usage(spark: SparkSession, d: str) -> DataFrame:
    return fx.extents(spark, d).groupBy("file").agg(F.sum("length").alias("physical_blocks"), F.max(F.col("logical") + F.col("length")).alias("allocated"))


@query(f"""WITH {fx.EXTENTS}, c AS (SELECT file + 1000000 AS file, logical, physical, length FROM extents), a AS (SELECT * FROM extents UNION ALL SELECT * FROM c)
SELECT file, count(*)::BIGINT AS extents, sum(length)::BIGINT AS blocks, (SELECT count(*) FROM (SELECT physical FROM a GROUP BY physical, length HAVING count(*) > 1))::BIGINT AS shared FROM a GROUP BY file""")
def j19_reflink(spark: SparkSession, d: str) -> DataFrame:
    """A clone shares all source extents: an insert-select of extent rows; shared ranges are those pinned twice."""
    src = fx.extents(spark, d)
    both = src.unionByName(src.withColumn("file", F.col("file") + 1000000))
    shared = both.groupBy("physical", "length").count().filter("count > 1").select("physical").agg(F.count("*").alias("shared"))
    per = both.groupBy("file").agg(F.count("*").alias("extents"), F.sum("length").alias("blocks"))
    return per.crossJoin(F.broadcast(shared))




@query("""SELECT p_partkey AS block, p_partkey % 4 AS r0_device, p_partkey // 4 AS r0_row,
 (p_partkey // 3) % 4 AS p5, (p_partkey % 3 + CASE WHEN p_partkey % 3 >= (p_partkey // 3) % 4 THEN 1 ELSE 0 END) AS d5,
 (p_partkey // 2) % 4 AS p6, (p_partkey // 2 + 1) % 4 AS q6,
 list_filter([0, 1, 2, 3], lambda x: x <> (p_partkey // 2) % 4 AND x <> (p_partkey // 2 + 1) % 4)[p_partkey % 2 + 1]::BIGINT AS d6 FROM part""")
def j17_stripe_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Four devices: striping; one rotating parity; P and Q on neighbouring devices. Data columns skip the parity devices."""
    b = F.col("p_partkey")
    row5, row6 = F.floor(b / 3), F.floor(b / 2)
    data = lambda parity, col: F.get(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda x: ~parity(x)), col.cast("int"))
    return t(spark, d, "part").select(
        b.alias("block"), (b % 4).alias("r0_device"), F.floor(b / 4).alias("r0_row"), (row5 % 4).alias("p5"), data(lambda x: x == row5 % 4, b % 3).alias("d5"),
        (row6 % 4).alias("p6"), ((row6 + 1) % 4).alias("q6"), data(lambda x: (x == row6 % 4) | (x == (row6 + 1) % 4), b % 2).alias("d6"),
    )
