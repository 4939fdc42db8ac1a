"""GF(256) parity and Reed-Solomon coding of equal-length shards, vectorised over bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.plans.registry import query
from cairn.sources.fixtures import t

REDUCE = 0x11D


def _powers() -> np.ndarray:
    out, x = [], 1
    for _ in range(255):
        out.append(x)
        x <<= 1
        if x > 255:
            x ^= REDUCE
    return np.array(out * 2, np.uint8)


EXP = _powers()
LOG = np.zeros(256, np.int64)
LOG[EXP[:255]] = np.arange(255)


def times(a: np.ndarray, c: int) -> np.ndarray:
    """Every byte times a constant."""
    if c == 0:
        return np.zeros_like(a)
    return np.where(a == 0, 0, EXP[LOG[a] + LOG[c]]).astype(np.uint8)


def inverse(m: np.ndarray) -> np.ndarray:
    """Gauss-Jordan over the field; singular matrices raise."""
    n = len(m)
    a = np.concatenate((m.astype(np.uint8), np.eye(n, dtype=np.uint8)), axis=1)
    for i in range(n):
        p = next((r for r in range(i, n) if a[r, i]), None)
        if p is None:
            raise ValueError("these shards do not determine the rest")
        a[[i, p]] = a[[p, i]]
        a[i] = times(a[i], int(EXP[(255 - LOG[a[i, i]]) % 255]))
        for r in range(n):
            if r != i and a[r, i]:
                a[r] ^= times(a[i], int(a[r, i]))
    return a[:, n:]


def generator(k: int, m: int) -> np.ndarray:
    """(k + m) x k: the identity, then Cauchy rows, so that any k rows are independent."""
    inv = lambda x: int(EXP[(255 - LOG[x]) % 255])
    rows = [[inv((k + i) ^ j) for j in range(k)] for i in range(m)]
    return np.concatenate((np.eye(k, dtype=np.uint8), np.array(rows, np.uint8).reshape(m, k)))


def combine(matrix: np.ndarray, shards: np.ndarray) -> np.ndarray:
    out = np.zeros((len(matrix), shards.shape[1]), np.uint8)
    for r, row in enumerate(matrix):
        for c, v in enumerate(row):
            if v:
                out[r] ^= times(shards[c], int(v))
    return out


def encode(data: np.ndarray, m: int) -> np.ndarray:
    """k data shards -> k + m shards, data first."""
    return combine(generator(len(data), m), data)


def reconstruct(survivors: dict[int, np.ndarray], k: int, m: int) -> np.ndarray:
    """All shards from any k of them."""
    if len(survivors) < k:
        raise ValueError(f"{len(survivors)} shards of {k} survive")
    at = sorted(survivors)[:k]
    g = generator(k, m)
    return combine(g, combine(inverse(g[at]), np.stack([survivors[i] for i in at])))


def pq_parity(columns: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """P: xor; Q: sum of each block times 2 to its column."""
    p = q = None
    for col, b in sorted(columns.items()):
        p = b.copy() if p is None else p ^ b
        term = times(b, int(EXP[col % 255]))
        q = term if q is None else q ^ term
    return p, q


def padded(pieces: list[bytes]) -> np.ndarray:
    n = max(map(len, pieces))
    return np.stack([np.frombuffer(p.ljust(n, b"\0"), np.uint8) for p in pieces])


def matrix_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The values as rows of one array, filled up with zeros, and their lengths."""
    lens = np.array([len(x) for x in raw], np.int64)
    out = np.zeros((len(raw), int(lens.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < lens[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    return out, lens


def by_stripe(rows: DataFrame, order: str, data: str, code: Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Stripes are the rows of one `g`, in order. `code(g, shards, lens)` gets all stripes of a batch that have k shards: shards is k x stripes x bytes, zeros after lens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t_ = pa.Table.from_batches([b])
            t_ = pa.concat_tables([held, t_]) if held else t_
            g = t_["g"].to_numpy()
            last = len(g) - int(np.argmax(np.concatenate((g[::-1] != g[-1], [True])))) if len(g) else 0
            held = t_.slice(last)
            if last:
                yield of(t_.slice(0, last))
        if held and len(held):
            yield of(held)

    def of(t_: pa.Table) -> pa.RecordBatch:
        g, (shards, lens) = t_["g"].to_numpy(), matrix_of(t_["data"].to_pylist())
        at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.append(at, len(g)))
        out = []
        for k in np.unique(size):
            rows_ = at[size == k][None, :] + np.arange(k)[:, None]
            out += code(g[rows_[0]], shards[rows_], lens[rows_].max(axis=0))
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=kinds)

    kinds = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    names = kinds.names
    dealt = rows.select("g", order, F.col(data).cast("binary").alias("data")).repartition("g").sortWithinPartitions("g", order)
    return dealt.select("g", "data").mapInArrow(run, schema)


def coded(matrix: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """`combine` over shards x stripes x bytes."""
    return combine(matrix, shards.reshape(len(shards), -1)).reshape(len(matrix), *shards.shape[1:])


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts in groups of four."""
    return t(spark, d, "part").select(F.expr("p_partkey div 4").alias("g"), "p_partkey", "p_name")


@query()
def a20_parity_encode(spark: SparkSession, d: str) -> DataFrame:
    """P, Q and two coded shards of each group of four."""

    def code(g: np.ndarray, s: np.ndarray, lens: np.ndarray) -> list[tuple]:
        p, q = pq_parity(dict(enumerate(s)))
        c = coded(generator(len(s), 2)[len(s) :], s)
        return [(i, *(x[j, :n].tobytes().hex() for x in (p, q, *c))) for j, (i, n) in enumerate(zip(g.tolist(), lens.tolist(), strict=True))]

    return by_stripe(_groups(spark, d), "p_partkey", "p_name", code, "g long, p string, q string, c0 string, c1 string")


def restored(full: np.ndarray, k: int, m: int, lost: list[set[int]]) -> np.ndarray:
    """shards x stripes x bytes, of which each stripe lost its own: all of them from k survivors, a solve for each set of losses."""
    back = np.empty_like(full)
    for kind in set(map(frozenset, lost)):
        at = np.array([i for i, x in enumerate(lost) if x == kind])
        back[:, at] = coded_survivors({i: full[i][at] for i in range(k + m) if i not in kind}, k, m)
    return back


def coded_survivors(survivors: dict[int, np.ndarray], k: int, m: int) -> np.ndarray:
    shape = next(iter(survivors.values())).shape
    return reconstruct({i: x.reshape(-1) for i, x in survivors.items()}, k, m).reshape(k + m, *shape)


@query()
def a21_rs_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """Two shards of each group are lost and rebuilt: whether all come back as they were."""

    def code(g: np.ndarray, s: np.ndarray, lens: np.ndarray) -> list[tuple]:
        n = len(s) + 2
        full = coded(generator(len(s), 2), s)
        lost = [{int(i) % n, int(i) // 7 % n} for i in g]
        same = (restored(full, len(s), 2, lost) == full).all(axis=(0, 2))
        return [(int(i), len(x), bool(ok)) for i, x, ok in zip(g, lost, same, strict=True)]

    return by_stripe(_groups(spark, d), "p_partkey", "p_name", code, "g long, lost long, restored boolean")
