"""A filter of bounded size over hashed values: it may let through others, but keeps back none of its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each value, and at most; a full filter lets more through, never fewer.
FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 26


def bit_filter(values: DataFrame, n: int) -> np.ndarray:
    """The filter of n hashed values (x), two bits each: words of 64 bits."""
    bits = min(MAX_FILTER_BITS, max(64, 1 << (FILTER_BITS * n).bit_length()))
    places = [F.pmod("x", F.lit(bits)), F.pmod(F.shiftrightunsigned("x", 32), F.lit(bits))]
    put = values.select(F.explode(F.array(*places)).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    got = put.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most MAX_FILTER_BITS / 64 rows
    words = np.zeros(bits // 64, np.int64)
    words[got["w"].to_numpy()] = got["b"].to_numpy()
    return words.view(np.uint64)


def may_hold(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of these hashed values the filter may hold."""
    ok = np.ones(len(x), bool)
    for p in (x.view(np.uint64) % np.uint64(64 * len(words)), (x.view(np.uint64) >> np.uint64(32)) % np.uint64(64 * len(words))):
        ok &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok
