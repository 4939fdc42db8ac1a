"""Exact top-k search by distributed histogram selection.

Scores are integers. A global histogram of scores per query locates the bin of its kth best; that bin is split
until it is one score wide. Then only scores at or above it leave the tasks, ties by smaller id. A task reports
only the bins of its own k best, as nothing below them can be among the k best of all, and so at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import operator, stash

BINS, QUERY_BLOCK = 4096, 4096
#: Scores that a task holds at once: queries of a block times candidates.
SCORES = 1 << 20


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null for vectors that are null or hold null or non-finite components."""
    ok = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _scored(q_rows: np.ndarray, q: np.ndarray) -> Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Blocks of (ids, scores: queries x candidates); a query's own row is no candidate, marked by the least long."""
    many = max(16, SCORES // max(1, len(q)))

    def scores(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(b), many):
            part = b.slice(at, many)
            ids, rows = part.column(0).to_numpy(), part.column(2).to_numpy()
            lens = np.diff(part.column(1).offsets.to_numpy())
            dims = q.shape[1]
            fit = lens == dims  # vectors of another length have no inner product with these
            flat = part.column(1).flatten().to_numpy()
            if not fit.all():
                flat = flat[np.repeat(fit, lens)]
            ids, rows, x = ids[fit], rows[fit], flat.reshape(-1, dims)
            # Doubles are exact while |score| < 2^53; beyond, integer products.
            big = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dims >= 2.0**53
            s = q @ x.T if big else (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
            own, where = np.isin(rows, q_rows), np.searchsorted(q_rows, rows)  # q_rows ascend
            s[where[own], np.flatnonzero(own)] = np.iinfo(np.int64).min
            yield ids, s

    return scores


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """Each row's kth largest, the least long if it has fewer."""
    if s.shape[1] < k:
        return np.full(len(s), np.iinfo(np.int64).min)
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]


def _histogram(rows: DataFrame, q_rows: np.ndarray, q: np.ndarray, k: int, lo: np.ndarray, width: np.ndarray) -> DataFrame:
    """(query, bin, n) over scores in [lo, lo + BINS * width), lo and width by query; bin BINS counts those above."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((q_rows, q, lo, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_rows, q, lo, width = held.value
        scores, floor = _scored(q_rows, q), np.full(len(q), np.iinfo(np.int64).min)
        where, count = [], {}
        for b in batches:
            for _, s in scores(b):
                floor = np.maximum(floor, _kth(s, k))
                hit = (s >= np.maximum(floor, lo)[:, None]) & (s > np.iinfo(np.int64).min)
                i, j = np.nonzero(hit)
                v = np.minimum((s[i, j] - lo[i]) // width[i], BINS)
                where, n = np.unique(i * (BINS + 1) + v, return_counts=True)
                for key, m in zip(where.tolist(), n.tolist(), strict=True):
                    count[key] = count.get(key, 0) + m
        if count:
            key = np.fromiter(count, np.int64)
            i, v = key // (BINS + 1), key % (BINS + 1)
            keep = v >= np.clip((floor[i] - lo[i]) // width[i], 0, BINS) if len(i) else []
            keep |= floor[i] < lo[i]
            n = np.fromiter(count.values(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(v[keep]), pa.array(n[keep])], names=["q", "bin", "n"])

    return rows.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _select(rows: DataFrame, q_ids: np.ndarray, q_rows: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> DataFrame:
    """Each task's scores at or above the kth value, of ties only the k smallest ids; at most k rows a query and task."""
    held = rows.sparkSession.sparkContext.broadcast((q_ids, q_rows, q, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_rows, q, least = held.value
        scores = _scored(q_rows, q)
        qi, ci, sc = (np.empty(0, np.int64) for _ in range(3))
        for b in batches:
            for ids, s in scores(b):
                i, j = np.nonzero((s >= least[:, None]) & (s > np.iinfo(np.int64).min))
                qi, ci, sc = np.concatenate((qi, i)), np.concatenate((ci, ids[j])), np.concatenate((sc, s[i, j]))
                order = np.lexsort((ci, ~sc, qi))
                qi, ci, sc = qi[order], ci[order], sc[order]
                first = np.searchsorted(qi, qi)
                top = np.arange(len(qi)) - first < k
                qi, ci, sc = qi[top], ci[top], sc[top]
        if len(qi):
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[qi]), pa.array(q_rows[qi]), pa.array(ci), pa.array(sc)], names=["query_id", "query_row", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, query_row long, vec_id long, score long")


@operator
def search(vectors: DataFrame, queries: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that `queries` selects.

    Score: integer inner product of the quantised vectors; ties to the smaller id. Vectors that are null, or hold
    null or non-finite components, or have no id, take no part; nor do pairs of different lengths. Rows that share an
    id each have a list of their own, and are candidates of one another. The queries are read in blocks of fixed size,
    each against all rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), queries.alias("is_query")).filter("id is not null and v is not null")
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "topk")  # written, the numbers stay
    n, most = rows.agg(F.count(F.when(F.col("is_query") & (F.size("v") > 0), 1)), F.max(F.array_max(F.transform("v", F.abs)))).first()
    blocks = max(1, -(-2 * n // block)) if n > block else 1  # half a block each, by hash
    asked = rows.filter("is_query and size(v) > 0").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    parts = []
    for number in range(blocks):
        by_length: dict[int, list] = {}
        for r in asked.filter(F.col("block") == number).select("row", "id", "v").orderBy("row").collect():
            by_length.setdefault(len(r["v"]), []).append(r)
        for same in by_length.values():
            parts.append(_search_block(rows.select("id", "v", "row"), [np.array([r[c] for r in same], np.int64) for c in ("id", "row", "v")], k, int(most or 0)))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search_block(rows: DataFrame, asked: list[np.ndarray], k: int, most: int) -> DataFrame:
    q_ids, q_rows, q = asked
    bound = int(np.abs(q).sum(axis=1).max()) * most + 1
    lo = np.full(len(q), -bound, np.int64)
    width = np.full(len(q), max(1, -(-2 * bound // BINS)), np.int64)
    open_ = np.ones(len(q), bool)
    while open_.any():
        hist = _histogram(rows, q_rows[open_], q[open_], k, lo[open_], width[open_])
        best = Window.partitionBy("q").orderBy(F.desc("bin"))
        edge = hist.withColumn("upto", F.sum("n").over(best))
        found = edge.groupBy("q").agg(F.max(F.when(F.col("upto") >= k, F.col("bin"))).alias("bin")).collect()  # a row for each query of the block
        at, still = np.flatnonzero(open_), np.zeros(len(q), bool)
        lows = np.full(len(q), np.iinfo(np.int64).min, np.int64)  # fewer than k scores: all are taken
        for r in found:
            i = at[r["q"]]
            if r["bin"] is not None:
                lows[i] = lo[i] + r["bin"] * width[i]
                still[i] = width[i] > 1
        for i in at:
            lo[i] = lows[i]
            width[i] = max(1, -(-width[i] // BINS)) if still[i] else 1
        open_ = still
    picked = _select(rows, q_ids, q_rows, q, k, lo)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return picked.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
