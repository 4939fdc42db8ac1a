import random
import re
import time

import numpy as np
import pytest
import xxhash

from cairn.llm import simhash
from cairn.llm.components import connected_components
from tests.llm.data import docs, rows


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, edges):
    of = list(range(n))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        of[b] = a
    return [find(i) for i in range(n)]


def test_against_all_pairs(spark):
    data = rows(n=150)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    for i in range(200, 260):  # near copies in chains
        base[rng.randint(0, 299)] = f"n{i}"
        data.append((i, " ".join(base), "en", "s", 0))
    got = simhash.near_groups(docs(spark, data)).collect()
    assert len(got) == len(data)
    fp = {i: brute_fingerprint(t) for i, t, *_ in data}
    ids = sorted(fp)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (fp[ids[a]] ^ fp[ids[b]]).bit_count() <= 3]
    comp = dict(zip(ids, (ids[r] for r in classes(len(ids), links)), strict=True))
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", comp[r.doc_id])
    assert len(set(comp.values())) < len(ids) - 20
    kept = simhash.drop_near_duplicates(docs(spark, data))
    assert {r.doc_id for r in kept.collect()} == set(comp.values()) and kept.columns == docs(spark, data).columns


@pytest.mark.parametrize("distance", [0, 1, 3, 6])
def test_index_loses_no_link(spark, distance):
    """Random fingerprints with planted neighbours at every distance, spread over the bits."""
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps):
        for n in range(1, 8):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    fps = sorted(fps)
    signed = [int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps]
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), distance).collect()
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance]
    at = {s: i for i, s in enumerate(signed)}
    pairs = [(at[r.a], at[r.b]) for r in got]
    assert set(map(tuple, map(sorted, pairs))) <= set(map(tuple, map(sorted, want)))
    assert classes(len(fps), pairs) == classes(len(fps), want)


def test_long_lists_are_dealt_again(spark, monkeypatch):
    """Fingerprints that agree in five bytes, in lists longer than one task may hold."""
    monkeypatch.setattr(simhash, "HELD", 500)
    rng = random.Random(2)
    low = list({rng.getrandbits(24) for _ in range(1500)} | {5 ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(24)})
    fps = [0x7A7A7A7A7A000000 + x for x in low]
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    post = simhash.postings(df, [0xFF << 56])  # one list for all
    first = simhash.links_of_lists(post, 3)
    assert first.filter("mask <> 0").count() == len(fps)
    at = {f: i for i, f in enumerate(fps)}
    pairs = [(at[r.a], at[r.b]) for r in simhash.links(df, 3).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in pairs)
    assert classes(len(fps), pairs) == classes(len(fps), want)


def test_one_list_of_unlinked_fingerprints():
    """40,000 fingerprints under one key: compared by further bits, not each with each."""
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 48, 40_000, dtype=np.uint64)) | np.uint64(77 << 48)
    fps = np.concatenate((fps, fps[:50] ^ np.uint64(0b111)))
    began = time.perf_counter()
    found = simhash.list_links(fps, 0xFFFF << 48, 3)
    assert time.perf_counter() - began < 5
    pairs = {frozenset((int(x), int(y))) for a, b in found for x, y in zip(a, b, strict=True)}
    assert {frozenset((int(f), int(f) ^ 7)) for f in fps[:50]} <= pairs
    assert all((x ^ y).bit_count() <= 3 for x, y in map(tuple, pairs))


def test_one_id_before_several_texts(spark):
    """Only the copy goes, not another text under its id; of whole rows that repeat one stays."""
    a = " ".join(f"w{i}" for i in range(200))
    data = [(3, a, "en", "s", 0), (5, a + " more", "en", "s", 0), (5, "something wholly different stands here", "en", "s", 0), (5, "something wholly different stands here", "en", "s", 0)]
    data += [(7, "twice the same id " * 20, "en", "s", 0), (7, "twice the same id " * 20 + "x", "en", "s", 0)]
    kept = simhash.drop_near_duplicates(docs(spark, data), distance=8 - 1, width=3, similarity=(4, 5)).collect()
    assert sorted((r.doc_id, r.text[:5]) for r in kept) == [(3, "w0 w1"), (5, "somet"), (7, "twice")]


def test_empty_texts_and_missing_ids(spark):
    data = [(5, None, None, None, 0), (3, " ", None, None, 0), (None, "", None, None, 0), (None, "alone here now", None, None, 0)]
    got = sorted(map(tuple, simhash.near_groups(docs(spark, data)).collect()), key=repr)
    zero = "0" * 16
    assert [x for x in got if x[1] == zero] == [(3, zero, 3), (5, zero, 3), (None, zero, 3)]
    assert [x[2] for x in got if x[1] != zero] == [None]
    assert simhash.near_groups(docs(spark, [])).count() == 0
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, data)).collect()} == {3, None}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 160)] + [(300, 300 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(400, edges)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: want[n] for n in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
