import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import packing
from cairn.llm.mixing import word_count
from tests.llm.data import docs, rows


def brute(rows, capacity):
    """Best fit by looking at every bin: the least residual that holds the document and has neither its source nor its cluster."""
    bins, out = [], []
    for size, source, cluster in rows:
        fit = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        out.append(bins[i]["left"])
        bins[i]["left"] -= size
        bins[i]["s"] |= {source} - {None}
        bins[i]["c"] |= {cluster} - {None}
    return out, len(bins)


@pytest.mark.parametrize("track_after", [1, 5, 10**9])
@pytest.mark.parametrize("seed", range(4))
def test_takes_the_tightest_compatible_bin(seed, track_after):
    """Residuals at placing equal those of a full search while no two bins tie; always a legal packing of tightest fit."""
    rng = random.Random(seed)
    items = sorted(((rng.randint(0, 60), rng.choice(["a", "a", "b", "c", None]), rng.choice([None, 1, 2, 3, 3])) for _ in range(250)), key=lambda x: -x[0])
    placed = packing.pack(items, 100, track_after)
    open_, load = defaultdict(lambda: {"left": 100, "s": set(), "c": set()}), 0
    for (size, source, cluster), (b, start) in zip(items, placed, strict=True):
        fit = [x["left"] for x in open_.values() if x["left"] >= size and (source is None or source not in x["s"]) and (cluster is None or cluster not in x["c"])]
        assert (b in open_) == bool(fit)
        if fit:
            assert open_[b]["left"] == min(fit)
        x = open_[b]
        assert start == 100 - x["left"] and x["left"] >= size and source not in x["s"] and cluster not in x["c"]
        x["left"] -= size
        x["s"] |= {source} - {None}
        x["c"] |= {cluster} - {None}
        load += size
    assert len(open_) <= brute(items, 100)[1] * 1.2


def test_every_row_is_placed(spark):
    data = rows(n=200)
    got = packing.pack_documents(docs(spark, data), size=word_count(F.col("text")), source=F.col("source"), cluster=F.md5(F.coalesce("text", F.lit(""))), capacity=64, per_shard=50).collect()
    words = defaultdict(int)
    for r in got:
        words[r.doc_id] += r.size
    want = defaultdict(int)
    for i, t, *_ in data:
        want[i] += len((t or "").encode().split())
    assert dict(words) == dict(want)
    of = {i: (s, t or "") for i, t, _, s, _ in data}
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for name, rs in bins.items():
        assert sum(r.size for r in rs) <= 64
        at = 0
        for r in sorted(rs, key=lambda r: (r.start, r.size)):
            assert r.start == at
            at += r.size
        if not name.startswith("full"):
            sources = [of[r.doc_id][0] for r in rs if of[r.doc_id][0] is not None]
            texts = [of[r.doc_id][1] for r in rs]
            assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)


def test_reruns_agree_and_empty(spark):
    d = docs(spark, rows(n=100))
    run = lambda: sorted(map(tuple, packing.pack_documents(d, size=word_count(F.col("text")), source=F.col("source"), capacity=100, per_shard=20).collect()))
    assert run() == run()
    assert packing.pack_documents(docs(spark, []), size=F.lit(1)).count() == 0
    assert packing.pack_documents(docs(spark, [(1, None, None, None, None)]), size=F.lit(None)).count() == 1


def test_a_hot_source_and_cluster_stay_fast():
    """All of one source and cluster: every document opens a bin, and none is looked at twice."""
    items = [(10, "hot", "same")] * 5000
    placed = packing.pack(items, 100)
    assert len({b for b, _ in placed}) == 5000


def test_rows_without_or_with_one_id_spread_over_the_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 1000)
    many = spark.range(300_000).select(F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.lit(700).alias("n"))
    many = many.unionByName(spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"), (F.col("id") % 900).cast("int").alias("n")))
    run = lambda: packing.pack_documents(many, size=F.col("n"), source=F.col("source"), capacity=2048, per_shard=2048)
    out = run()
    per = out.groupBy("shard").count().agg(F.max("count").alias("most"), F.count("*").alias("shards")).first()
    assert out.count() == 320_000 and per.shards == 157 and per.most < 2600
    mark = lambda df: df.agg(F.bit_xor(F.xxhash64(*df.columns)), F.sum("size"), F.countDistinct("bin_id")).first()
    assert mark(out) == mark(run())
