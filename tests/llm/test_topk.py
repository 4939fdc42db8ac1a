import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import queries, topk
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<float>, query_id string, rank string, v string, id string"


def table(spark, data):
    return spark.createDataFrame([(i, v, "c", "c", "c", "c") for i, v in data], SCHEMA)


def brute(data, k, every):
    import numpy as np

    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(float(np.float32(x)) * 256) for x in v]) for i, v in data if i is not None and ok(v)]
    out = []
    for at, (i, v) in enumerate(rows):
        if i % every == 0 and v:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for other, (j, w) in enumerate(rows) if other != at and len(w) == len(v))
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s[:k])]
    return sorted(out)


def data(n=300, dims=8, seed=2):
    rng = random.Random(seed)
    out = [(i, [rng.uniform(-1, 1) for _ in range(dims)]) for i in range(n)]
    for i in range(50, 150):
        out[i] = (i, out[50][1])  # a third of all are one vector: ties at every score
    return out + [(1000, None), (1001, [None] * dims), (1002, [float("nan")] * dims), (1004, [float("inf")] + [0.0] * (dims - 1)), (1008, [0.5] * 3), (1012, [0.25] * 3), (1016, []), (None, [0.1] * dims)]


@pytest.mark.parametrize(("bins", "block", "k"), [(4096, 4096, 5), (8, 16, 5), (64, 4096, 1), (16, 8, 400)])
def test_against_plain_python(spark, monkeypatch, bins, block, k):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "SCORES", 37 * 20)
    d = data()
    d += [d[8], d[8], d[60], (12, d[13][1]), (13, d[12][1])]  # ids that repeat, with the same and with other vectors
    got = topk.search(table(spark, d), F.col("vec_id") % 4 == 0, k=k, block=block).collect()
    assert sorted(map(tuple, got)) == brute(d, k, 4)


@pytest.mark.parametrize("d", [[], [(1, [0.5])], [(4, [0.5])], [(4, None)]])
def test_few_rows(spark, d):
    assert topk.search(table(spark, d), F.col("vec_id") % 4 == 0).collect() == []


def test_sql(spark):
    assert compare(spark, queries.op8_topk, queries.oracle_sql()["op8_topk"], "/root/testdata/sf0.001") == 50
