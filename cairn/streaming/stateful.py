"""Structured Streaming twins of the ordered operators.

State is kept by key with `applyInPandasWithState`; within a micro-batch a key's rows are ordered by (t, seq). The
checkpoint's offsets and commits stand for the log's checkpoint marks, `maxFilesPerTrigger` for backpressure.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.ordered import _BUCKET_SQL
from cairn.plans.registry import query
from cairn.sources import fixtures as fx
from cairn.shared import scratch

Step = Callable[[tuple, Any], tuple[tuple, tuple | None]]


def stateful(stream: DataFrame, key: str, output: str, state: str, start: tuple, step: Step) -> DataFrame:
    """Fold `step(state, row) -> (state, output row or None)` over each key's rows, across micro-batches."""
    names = [c.strip().split(" ")[0] for c in output.split(",")]

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        cur = s.get if s.exists else start
        rows = pd.concat(list(pdfs)).sort_values(["t", "seq"])
        out = []
        for r in rows.itertuples(index=False):
            cur, emitted = step(cur, r)
            if emitted is not None:
                out.append((k[0], *emitted))
        s.update(cur)
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def io_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """An I/O log (seq, t, ns, op, latency_us, bytes, block) as a stream of Parquet files."""
    return spark.readStream.schema("seq long, t long, ns long, op string, latency_us long, bytes long, block long").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bucket_step(rate_b: int, rate_o: int, burst_b: int, burst_o: int) -> tuple[tuple, Step]:
    def step(s: tuple, r: Any) -> tuple[tuple, tuple]:
        b, o, at = s
        dt = max(0, r.t - at)
        b, o, at = min(b + dt * rate_b, burst_b), min(o + dt * rate_o, burst_o), max(at, r.t)
        ok = b >= r.bytes and o >= 1
        b, o = (b - r.bytes, o - 1) if ok else (b, o)
        return (b, o, at), (r.seq, ok, b)

    return (burst_b, burst_o, 0), step


def rate_limit_step(gap: int) -> tuple[tuple, Step]:
    """Emit a window (86400 s) if `gap` windows have passed since the last emission."""

    def step(s: tuple, r: Any) -> tuple[tuple, tuple | None]:
        e = r.t // 86400
        return ((e,), (e,)) if s[0] is None or s[0] < 0 or e - s[0] >= gap else (s, None)

    return (-1,), step


def ewma_step() -> tuple[tuple, Step]:
    """Latency: the first sample sets, then an eighth of the old goes and an eighth of the new comes."""

    def step(s: tuple, r: Any) -> tuple[tuple, tuple]:
        c = r.latency_us if s[0] < 0 else s[0] - (s[0] >> 3) + (r.latency_us >> 3)
        return (c,), (r.seq, c)

    return (-1,), step


def guardian_step() -> tuple[tuple, Step]:
    """Three observers in one: quarter-weight size EWMA, latency EWMA and a shift event when the size class changes."""

    def step(s: tuple, r: Any) -> tuple[tuple, tuple | None]:
        size, lat, last = s
        size = (min(r.bytes, 1 << 20) + 3 * size) // 4
        lat = r.latency_us if lat < 0 else lat - (lat >> 3) + (r.latency_us >> 3)
        now = 0 if size < 4096 else 1 if size < 32768 else 2
        return (size, lat, now), (r.seq, size, lat, now) if now != last else None

    return (0, -1, -1), step


def commit_step(bytes_budget: int, records_budget: int) -> tuple[tuple, Step]:
    """Group commit: each record with its window's number; a window closes at a byte or record budget."""

    def step(s: tuple, r: Any) -> tuple[tuple, tuple]:
        w, b, n, closed = s
        if closed:
            w, b, n = w + 1, 0, 0
        b, n = b + r.bytes, n + 1
        return (w, b, n, b >= bytes_budget or n >= records_budget), (r.seq, w)

    return (0, 0, 0, False), step


def drain(stream: DataFrame, spark: SparkSession, checkpoint: str | None = None, sink: str | None = None) -> DataFrame:
    """Run until all input present is read, into a Parquet sink; the checkpoint may be used again to go on."""
    sink, checkpoint = sink or scratch(spark, "stream"), checkpoint or scratch(spark, "offsets")
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def _log(spark: SparkSession, d: str, parts: int = 3) -> DataFrame:
    """The fixture log as files, one a micro-batch, in order of time."""
    path = scratch(spark, f"log-{uuid.uuid4().hex[:4]}")
    o = fx.io_ops(spark, d).persist()
    cuts = o.approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)
    for i, (lo, hi) in enumerate(zip([-1, *cuts], [*cuts, 1 << 60], strict=True)):
        o.filter((F.col("t") > lo) & (F.col("t") <= hi)).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    o.unpersist()
    return io_stream(spark, f"{path}/*")


@query(_BUCKET_SQL + "SELECT ns, rs[i].seq AS seq, st[i + 1].ok AS admitted, st[i + 1].b AS tokens FROM z")
def w15_token_bucket_stream(spark: SparkSession, d: str) -> DataFrame:
    """The streaming twin, over three micro-batches, gives what the batch operator gives."""
    start, step = bucket_step(1, 1, 60000, 10)
    return drain(stateful(_log(spark, d), "ns", "ns long, seq long, admitted boolean, tokens long", "b long, o long, at long", start, step), spark)


@query(f"""WITH {fx.IO_OPS}, l AS (SELECT ns, list(latency_us ORDER BY t, seq) AS v FROM io_ops GROUP BY ns) SELECT ns, list_reduce(v, lambda c, n: c - (c >> 3) + (n >> 3)) AS ewma FROM l""")
def w3_latency_ewma_stream(spark: SparkSession, d: str) -> DataFrame:
    start, step = ewma_step()
    out = drain(stateful(_log(spark, d), "ns", "ns long, seq long, ewma long", "c long", start, step), spark)
    t = fx.io_ops(spark, d).select("seq", "t")
    return out.join(t, "seq").groupBy("ns").agg(F.max_by("ewma", F.struct("t", "seq")).alias("ewma"))


@query()
def r7_guardian_stream(spark: SparkSession, d: str) -> DataFrame:
    start, step = guardian_step()
    return drain(stateful(_log(spark, d), "ns", "ns long, seq long, size_ewma long, latency_ewma long, class long", "s long, l long, c long", start, step), spark)


@query()
def r1_group_commit_stream(spark: SparkSession, d: str) -> DataFrame:
    start, step = commit_step(40000, 8)
    return drain(stateful(_log(spark, d).filter("op = 'write'"), "ns", "ns long, seq long, window long", "w long, b long, n long, closed boolean", start, step), spark)


def daily_counts(stream: DataFrame, delay: str, spark: SparkSession, checkpoint: str | None = None, sink: str | None = None) -> DataFrame:
    """Rows by namespace and day of event time, of all input present; rows that come later than the watermark are dropped.

    Every micro-batch appends the windows that it changed; readers take the newest. The checkpoint may be used again.
    """
    counts = stream.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", delay).groupBy("ns", F.window("ts", "1 day")).agg(F.count("*").alias("ops"))
    flat = counts.select("ns", F.col("window.start").cast("long").alias("start"), "ops")
    sink, checkpoint = sink or scratch(spark, "windows"), checkpoint or scratch(spark, "offsets")
    write = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(sink)
    flat.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).groupBy("ns", "start").agg(F.max_by("ops", "batch").alias("ops"))


@query(f"WITH {fx.IO_OPS} SELECT ns, (t // 86400) * 86400 AS start, count(*)::BIGINT AS ops FROM io_ops GROUP BY 1, 2")
def r8_watermark_addition_stream(spark: SparkSession, d: str) -> DataFrame:
    """An addition: daily event-time windows; the delay exceeds the log's month, so no row of it is late."""
    return daily_counts(_log(spark, d), "40 days", spark)
