"""Content-defined chunking. The rolling hashes have finite memory, so they are computed for all bytes at once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.scalars import GOLDEN, splitmix64
from cairn.plans.registry import query
from cairn.sources.fixtures import t

#: The polynomial of degree 53 and the window in bytes.
POLY, DEGREE, WINDOW = 0x3DA3358B4DC173, 53, 48


def gear_table() -> np.ndarray:
    """Each entry is the mixer applied to the one before."""
    out, x = [], np.array([GOLDEN], np.uint64)
    for _ in range(256):
        x = splitmix64(x)
        out.append(x[0])
    return np.array(out, np.uint64)


def _times_x8(v: np.ndarray) -> np.ndarray:
    for _ in range(8):
        v = v << np.uint64(1)
        v = np.where(v >> np.uint64(DEGREE) & np.uint64(1), v ^ np.uint64(POLY), v)
    return v


def window_tables() -> list[np.ndarray]:
    """By distance from the newest byte: each byte value times x^(8 k), reduced."""
    out = [np.arange(256, dtype=np.uint64)]
    for _ in range(WINDOW - 1):
        out.append(_times_x8(out[-1]))
    return out


GEAR, TABLES = gear_table(), window_tables()


def fastcdc(data: bytes, low: int = 2048, avg: int = 8192, high: int = 32768) -> list[int]:
    """Chunk lengths. Nothing is cut before `low`; up to `avg` a longer mask, then a shorter one; the byte that matched begins the next chunk."""
    bits = max(avg - low, 1).bit_length()
    short = max(bits // 2, 1)
    b = GEAR[np.frombuffer(data, np.uint8)]
    h = np.zeros(len(b), np.uint64)
    for k in range(min(bits, len(b))):  # a mask of n bits sees the last n bytes only
        h[k:] += b[: len(b) - k] << np.uint64(k)
    hard, soft = (np.flatnonzero(h & np.uint64((1 << n) - 1) == 0) for n in (bits, short))
    out, pos = [], 0
    while pos < len(data):
        end = min(pos + high, len(data))
        a, m = min(pos + low, end), min(pos + avg, end)
        i, j = np.searchsorted(hard, a), np.searchsorted(soft, m)
        cut = hard[i] if i < len(hard) and hard[i] < m else soft[j] if j < len(soft) and soft[j] < end else end
        out.append(int(cut) - pos)
        pos = int(cut)
    return out


def rabin(data: bytes, low: int = 2048, avg: int = 8192, high: int = 32768) -> list[int]:
    """Chunk lengths by a polynomial fingerprint of the last 48 bytes, which runs on across cuts; the byte that matched ends its chunk."""
    b = np.frombuffer(data, np.uint8)
    f = np.zeros(len(b), np.uint64)
    for k in range(min(WINDOW, len(b))):
        f[k:] ^= TABLES[k][b[: len(b) - k]]
    marks = np.flatnonzero(f & np.uint64(avg - 1) == 0) + 1
    out, pos = [], 0
    while pos < len(data):
        end = min(pos + high, len(data))
        i = np.searchsorted(marks, pos + low)
        cut = int(marks[i]) if i < len(marks) and marks[i] < end else end
        out.append(cut - pos)
        pos = cut
    return out


def chunks(objects: DataFrame, id_col: str, data: Column, cut: Callable[[bytes], list[int]], label: Column | None = None) -> DataFrame:
    """(id, pos, start, length, hash, label) of every chunk of every object; Arrow batches in, rows out, no shuffle. label: a string that goes with the object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, raw, of in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw, at = raw.as_py() or b"", 0
                for k, n in enumerate(cut(raw)):
                    rows.append((i, k, at, n, hashlib.sha256(raw[at : at + n]).hexdigest(), of))
                    at += n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "pos", "start", "length", "hash", "label"])

    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    rows = objects.select(F.col(id_col).cast("long").alias("id"), data.cast("binary").alias("data"), (F.lit(None) if label is None else label).cast("string").alias("label"))
    return rows.mapInArrow(run, "id long, pos long, start long, length long, hash string, label string")


@query()
def x8_rabin_cdc(spark: SparkSession, d: str) -> DataFrame:
    return chunks(t(spark, d, "documents"), "doc_id", F.col("text"), rabin).drop("label")


@query()
def x9_fastcdc(spark: SparkSession, d: str) -> DataFrame:
    return chunks(t(spark, d, "documents"), "doc_id", F.col("text"), fastcdc).drop("label")


@query()
def a1_cdc_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Per domain (language): chunks, logical, unique, stored, eliminated, least and greatest length, ratio. Hashes are combined before the shuffle."""
    c = chunks(t(spark, d, "documents"), "doc_id", F.col("text"), lambda b: fastcdc(b, 256, 1024, 4096), F.col("lang"))
    h = c.groupBy(F.col("label").alias("domain"), "hash").agg(F.count("*").alias("n"), F.max("length").alias("len"))
    s = h.groupBy("domain").agg(F.sum("n").alias("chunks"), F.sum(F.col("n") * F.col("len")).alias("logical"), F.count("*").alias("unique"), F.sum("len").alias("stored"), F.min("len").alias("least"), F.max("len").alias("greatest"))
    return s.withColumn("eliminated", F.col("logical") - F.col("stored")).withColumn("ratio", F.when(F.col("stored") > 0, F.round(F.col("logical") / F.col("stored"), 9)).otherwise(1.0))
