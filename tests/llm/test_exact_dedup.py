import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import exact_dedup as ed
from tests.llm.data import docs, rows


def brute(data, keep):
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    pick = max if keep == "largest" else min
    out = []
    for i, text, *_ in data:
        ids = groups[text or ""]
        k = pick((x for x in ids if x is not None), default=None)
        out.append((i, k, len(ids), i == k, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("memtable", [1, 1 << 12, 1 << 24])
def test_against_plain_python(spark, keep, memtable):
    data = rows(n=120) + [(None, "only without an id", None, None, None), (None, "two words", None, None, None)]
    got = ed.exact_groups(docs(spark, data), keep=keep, memtable_bytes=memtable)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data, keep)


def test_digest_clashes_are_resolved_by_the_bytes(spark):
    """A digest of four values: equal digests mostly stand for different texts."""
    data = rows(n=80)
    weak = lambda c: F.concat(F.lit("d"), (F.crc32(c.cast("binary")) % 4).cast("string"))
    got = ed.exact_groups(docs(spark, data), keep="largest", digest=weak, memtable_bytes=4096)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data, "largest")


def test_runs_and_their_merge():
    t = pa.table({"digest": ["b", "a", "b", "b"], "text": ["x", "y", "x", "z"], "key": [3, 9, 1, 2]})
    (memtable,) = ed.memtables(iter(t.to_batches()), 1 << 20)
    out = ed.run_of(memtable).to_pydict()
    assert out == {"digest": ["a", "b"], "key": [9, 1], "n": [1, 3], "clash": [False, True]}
    one = [{"digest": d, "key": k, "n": n, "clash": c} for d, k, n, c in [("a", 9, 1, False), ("b", 4, 2, False), ("b", 1, 3, True), ("c", 5, 1, False), ("c", 7, 1, False), ("c", 2, 1, False)]]
    for size in (1, 2, 4, 6):
        got = [r for b in ed.compacted(iter(pa.Table.from_pylist(one).to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert [tuple(r.values()) for r in got] == [("a", 9, 1, 1, False), ("b", 1, 5, 2, True), ("c", 2, 3, 3, False)]
    assert list(ed.compacted(iter([]))) == []


def test_filter_lets_every_hit_through(spark):
    digests = [f"{i:064x}" for i in range(0, 3000, 3)]
    hits = spark.createDataFrame([(d,) for d in digests], "digest string")
    words = ed.hit_filter(hits)
    x = spark.createDataFrame([(f"{i:064x}",) for i in range(3000)], "digest string").selectExpr("xxhash64(digest) AS x", "digest").collect()
    ok = ed.may_hold(words, np.array([r.x for r in x], np.int64))
    passed = {r.digest for r, y in zip(x, ok, strict=True) if y}
    assert set(digests) <= passed and len(passed) < 1200


def test_empty_table(spark):
    assert ed.exact_groups(docs(spark, [])).count() == 0
    assert ed.drop_duplicates(docs(spark, [])).count() == 0


def test_one_row_of_each_text_stays(spark):
    data = rows(n=120)
    kept = ed.drop_duplicates(docs(spark, data), keep="largest")
    assert kept.columns == docs(spark, data).columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r[1] or "" for r in data}
