"""Published examples of the operators, and second implementations in plain Python of those that SQL can't express."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions import chunking, erasure, scalars
from cairn.operators import aggregates, intervals, ordered, planning, scans, timeline
from cairn.operators.predicates import check_mode, import_plan, is_lure, risk_band
from cairn.sources import archives


def one(spark, col, **cols):
    return spark.range(1).withColumns({k: F.lit(v) for k, v in cols.items()}).select(col.alias("r")).first()[0]


def test_iso_weeks_and_budgets(spark):
    from datetime import datetime, timezone

    at = lambda *d: int(datetime(*d, tzinfo=timezone.utc).timestamp())
    s = spark.createDataFrame([(1, at(2021, 1, 1)), (2, at(2021, 1, 3)), (3, at(2021, 1, 4)), (4, at(2021, 1, 11))], "id long, at long")
    kept = {r.id: r.tier for r in ordered.retention(s, 0, 0, 9, 0, 0).collect()}
    assert kept == {2: "weekly", 3: "weekly", 4: "weekly"}  # a Sunday belongs to the Monday before
    hourly = spark.createDataFrame([(i, i * 3600) for i in range(1, 61)], "id long, at long")
    kept = {r.id for r in ordered.retention(hourly, 48, 0, 0, 0, 0).collect()}
    assert len(kept) == 48 and 1 not in kept
    assert ordered.retention(hourly, 0, 0, 0, 0, 0).count() == 0


def retain(snaps, budgets):
    """The tiers one after the other, each skipping what is kept already."""
    import datetime

    day = lambda t: datetime.date(1970, 1, 1) + datetime.timedelta(days=t // 86400)
    keys = {"daily": lambda t: t // 86400, "weekly": lambda t: day(t).isocalendar()[:2], "monthly": lambda t: (day(t).year, day(t).month), "yearly": lambda t: day(t).year}
    order = sorted(snaps, key=lambda s: (s[1], s[0]), reverse=True)
    kept = {i: "hourly" for i, _ in order[: budgets["hourly"]]}
    for tier, key in keys.items():
        seen, n = set(), 0
        for i, t in order:
            if n >= budgets[tier] or i in kept or key(t) in seen:
                continue
            seen.add(key(t))
            kept[i] = tier
            n += 1
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_retention_against_a_fold(spark, seed):
    rng = random.Random(seed)
    snaps = [(i, rng.randint(0, 4 * 365 * 86400)) for i in range(400)]
    b = {"hourly": 5, "daily": 9, "weekly": 11, "monthly": 8, "yearly": 2}
    got = {r.id: r.tier for r in ordered.retention(spark.createDataFrame(snaps, "id long, at long"), **b).collect()}
    assert got == retain(snaps, b)


SEG = 256 << 20


def segs(spark, rows):
    return spark.createDataFrame(rows, "segment long, total long, live long, age_s long, cycles long")


def test_gc_plan(spark):
    s = segs(spark, [(0, SEG, SEG // 2, 100, 0), (1, SEG, SEG // 2, 100, 0), (2, SEG, SEG // 2, 100, 0), (3, SEG, SEG, 0, 0)])
    assert [r.segment for r in planning.gc_plan(s, 100, 15, 86400).collect()] == [0, 1, 2]
    assert {r.urgency for r in planning.gc_plan(s, 100, 10, 86400).collect()} == {"background"}
    assert {r.urgency for r in planning.gc_plan(s, 100, 9, 86400).collect()} == {"aggressive"}
    assert planning.gc_plan(s, 100, 25, 86400).count() == 0


def test_gc_scores_against_integers(spark):
    rng = random.Random(1)
    rows = [(i, SEG, rng.choice([0, SEG, rng.randint(1, SEG)]), rng.randint(0, 10**7), rng.randint(0, 9000)) for i in range(200)]
    got = {r.segment: r.score for r in planning.gc_scores(segs(spark, rows), 86400, False).collect()}
    for i, total, live, age, cycles in rows:
        if live == total:
            assert i not in got
            continue
        benefit = (total - live) * ((1 << 32) + age * (1 << 32) // 86400) >> 32
        cost = 2 * live * ((1 << 32) + ((cycles * 8 // 100) << 32) // 10000) >> 32
        want = (1 << 63) - 1 if cost == 0 else (benefit << 20) // cost
        assert got[i] == want or abs(got[i] - want) <= want * 1e-12


def test_entropy(spark):
    data = [("all", bytes(range(256))), ("same", b"aaaa"), ("two", b"abab"), ("four", b"abcd" * 5), ("none", b"")]
    df = spark.createDataFrame(data, "k string, d binary")
    got = {r.k: r.entropy for r in aggregates.entropy_q32(aggregates.byte_histogram(df, "k", F.col("d")), "k").collect()}
    assert got == {"all": 8 << 32, "same": 0, "two": 1 << 32, "four": 2 << 32}


def test_suspicion_and_bands(spark):
    full = one(spark, F.struct(*ordered.suspicion(F.lit(8 << 32), F.lit(1 << 32), F.lit(1 << 32))))
    assert full.score_bps >= 9999 and full.freeze
    compressed = one(spark, F.struct(*ordered.suspicion(F.lit(8 << 32), F.lit(0).cast("long"), F.lit(0).cast("long"))))
    assert compressed.score_bps == 5000 and not compressed.freeze
    edges = {149: "healthy", 150: "watch", 399: "watch", 400: "degraded", 999: "degraded", 1000: "failing"}
    assert {x: one(spark, risk_band(F.lit(x))) for x in edges} == edges


@pytest.mark.parametrize(("realloc", "pending", "median", "p99", "want"), [(0, 0, 500, 900, 100), (5, 0, 500, 500, 300), (0, 0, 500, 5000, 300)])
def test_hazard_multipliers(spark, realloc, pending, median, p99, want):
    d = spark.createDataFrame([(10_000, realloc, pending, 0, 0, median, p99)], "hours long, realloc long, pending long, crc long, scrub long, median long, p99 long")
    got = scalars.hazard(d).first()
    assert got.multiplier == want
    assert got.remaining <= 876_000


@pytest.mark.parametrize(("size", "read", "sync", "seq", "want"), [(512, 0.5, 0, 0.1, "meta"), (1 << 19, 0.9, 0, 0.9, "stream"), (1 << 19, 0.0, 0.1, 0.95, "log"), (8192, 0.5, 0.1, 0.1, "db"), (4096, 0.5, 0.0, 0.05, "vm"), (1 << 17, 0.5, 0.0, 0.5, "vhost")])
def test_stream_classes(spark, size, read, sync, seq, want):
    q = lambda x: F.lit(int(x * (1 << 32)))
    assert one(spark, ordered.stream_class(F.lit(size), q(read), q(sync), q(seq))) == want


def test_histogram(spark):
    h = aggregates.histogram(spark.range(1, 101), "id")
    q = {r.q: r.value_us for r in aggregates.histogram_quantiles(h, [-1.0, 0.0, 0.5, 1.0, 2.0]).collect()}
    assert q[-1.0] == q[0.0] and q[1.0] == q[2.0] == 120
    assert aggregates.histogram(spark.range(1).select(F.lit((1 << 62)).alias("v")), "v").agg(F.max("cumulative")).first()[0] == 0


def test_rebalance(spark):
    tb = 1 << 40
    d = spark.createDataFrame([(0, 16 * tb, 4 * tb, 0, False), (1, 4 * tb, 0, 0, False)], "device long, capacity long, used long, band long, leaving boolean")
    got = {r.device: r.target for r in planning.rebalance_targets(d).collect()}
    assert got == {0: 16 * tb * 4 // 20, 1: 4 * tb * 4 // 20}
    d = spark.createDataFrame([(0, 100, 60, 0, False), (1, 100, 40, 0, True), (2, 100, 0, 3, False), (3, 100, 0, 2, False)], "device long, capacity long, used long, band long, leaving boolean")
    t = planning.rebalance_targets(d)
    assert {r.device: r.target for r in t.collect()} == {0: 33, 1: 0, 2: 0, 3: 16}
    moves = [(r["from"], r["to"], r["bytes"]) for r in planning.rebalance_moves(t, 10**9).collect()]
    assert moves == [(1, 3, 16)]  # the leaving device drains first


def test_models(spark):
    ctmc, spec = scalars.mttdl(F.lit(8), F.lit(2), 1e6, 4.0)
    assert one(spark, spec) == pytest.approx(1e18 / (10 * math.comb(9, 2) * 16 * 3))
    assert one(spark, ctmc) == pytest.approx(1e18 / (10 * 2 * math.comb(9, 2) * 16))


def test_fit_and_fragmentation(spark):
    c = spark.createDataFrame([(100, 20), (200, 8), (300, 50)], "start long, len long").filter("len >= 8")
    assert c.agg(F.min("start"), F.min(F.struct("len", "start"))["start"], F.max(F.struct("len", "start"))["start"]).first()[:] == (100, 200, 300)


def test_small_predicates(spark):
    assert [one(spark, is_lure(F.lit(p))) for p in ("a.PDF", "a/b.docx", "db", ".db", "x.txt")] == [True, True, False, True, False]
    mode = lambda u, w: one(spark, check_mode(F.lit(0o640), F.lit(u), F.lit(5), F.lit(1), F.lit(5), F.lit(w)))
    assert [mode(0, 7), mode(1, 6), mode(2, 4), mode(2, 2)] == [True, True, True, False]
    plan = spark.createDataFrame([("ntfs", 5 << 20, True), ("ext4", 9 << 40, True), ("xfs", 10, False)], "kind string, bytes long, mounted boolean")
    got = [tuple(r)[:3] for r in plan.select(*import_plan(F.col("kind"), F.col("bytes"), F.col("mounted"))).collect()]
    assert got == [("per-file", False, 5), ("tar-stream", False, 1000), ("raw-block", True, 1)]
    for kind, offset, magic, other in scans.MAGICS:
        for m in filter(None, (magic, other)):
            image = bytearray(65544)
            image[offset : offset + len(m) // 2] = bytes.fromhex(m)
            assert one(spark, scans.detect_format(F.lit(bytes(image)))) == kind
    assert one(spark, scans.detect_format(F.lit(b""))) is None


def test_normal_paths(spark):
    want = {"/a//b/./c": "/a/b/c", "/..": "/", "../x": "../x", "a/..": ".", "": ".", "/a/../../b": "/b", "../../a": "../../a"}
    assert {p: one(spark, scalars.normalize_path(F.lit(p))) for p in want} == want


def test_merkle_diff_of_two_edits(spark):
    def tree(a, b, c):
        h = lambda *x: str(zlib.crc32(repr(x).encode()))
        return spark.createDataFrame([(0, "a.txt", 1, h(a)), (0, "b.txt", 2, h(b)), (0, "sub", 3, h(c)), (3, "c.txt", 4, h(c)), (3, "d.txt", 5, h("d"))], "parent long, name string, child long, hash string")

    got = sorted(tuple(r) for r in timeline.merkle_diff(tree(1, 2, 3), tree(9, 2, 8), 0, 3).collect())
    assert got == [("/a.txt", "modified"), ("/sub/c.txt", "modified")]


def test_as_of_ties(spark):
    left = spark.createDataFrame([(1, 0, 10), (2, 0, 9), (3, 0, 100)], "id long, k long, t long")
    right = spark.createDataFrame([(0, 10, 7), (0, 10, 5), (0, 50, 9)], "k long, at long, snap long")
    got = {r.id: r.asof for r in timeline.as_of(left, right, on="k", left_time="t", right_time="at", tie="snap", value="snap").collect()}
    assert got == {1: 5, 2: None, 3: 9}


@pytest.mark.parametrize("seed", range(3))
def test_intervals_against_arrays(spark, seed):
    rng = random.Random(seed)
    ext = [(i, rng.randint(0, 300), rng.randint(0, 40)) for i in range(60)]
    df = spark.createDataFrame([(0, s, n) for _, s, n in ext], "k long, s long, n long")
    count = np.zeros(400, int)
    for _, s, n in ext:
        count[s : s + n] += 1
    got = np.zeros(400, int)
    runs = intervals.coverage_runs(df, "s", "n", "k")
    for r in runs.collect():
        assert not got[r.start : r.end].any()
        got[r.start : r.end] = r["count"]
    assert (got == count).all()
    asked = [(i, 0, rng.randint(0, 350), rng.randint(0, 20)) for i in range(80)]
    cov = intervals.fully_covered(spark.createDataFrame(asked, "id long, k long, s long, len long"), runs, "k", 16)
    assert {r.id: r.covered for r in cov.collect()} == {i: n > 0 and bool(count[s : s + n].all()) for i, _, s, n in asked}


def slow_fastcdc(data, low, avg, high):
    bits = (avg - low).bit_length()
    long_, short = (1 << bits) - 1, (1 << max(bits // 2, 1)) - 1
    gear = [int(g) for g in chunking.GEAR]
    out, pos = [], 0
    while pos < len(data):
        end = min(pos + high, len(data))
        h, cut = 0, end
        for i in range(pos, end):
            h = (h << 1) + gear[data[i]] & (1 << 64) - 1
            mask = None if i < pos + low else long_ if i < pos + avg else short
            if mask is not None and h & mask == 0:
                cut = i
                break
        out.append(cut - pos)
        pos = cut
    return out


def slow_rabin(data, low, avg, high):
    def mod(v):
        while v.bit_length() > 53:
            v ^= chunking.POLY << (v.bit_length() - 54)
        return v

    out, pos, window, f = [], 0, [0] * 48, 0
    x384 = mod(1 << 384)
    times = lambda a, b: mod(__import__("functools").reduce(lambda s, i: s ^ (a << i if b >> i & 1 else 0), range(8), 0))
    for i, b in enumerate(data):
        f = mod((f << 8) | b) ^ times(x384, window.pop(0))
        window.append(b)
        n = i + 1 - pos
        if (n >= low and f & (avg - 1) == 0) or n == high or i + 1 == len(data):
            out.append(n)
            pos = i + 1
    return out


@pytest.mark.parametrize("n", [0, 1, 100, 9000])
def test_chunkers_against_byte_loops(n):
    data = random.Random(n).randbytes(n)
    assert chunking.fastcdc(data, 64, 256, 1024) == slow_fastcdc(data, 64, 256, 1024)
    assert chunking.rabin(data, 600, 1024, 4096) == slow_rabin(data, 600, 1024, 4096)
    assert sum(chunking.fastcdc(data)) == n


def test_hashes():
    assert zlib.crc32(b"123456789") == 0xCBF43926
    assert scalars.fnv1a64(b"a") == 0xAF63DC4C8601EC8C

    def slow(data):
        a = b = 0xFFFF
        data += b"\0" * (len(data) % 2)
        for i in range(0, len(data), 2):
            a = (a + data[i] + 256 * data[i + 1]) % 0xFFFF
            b = (b + a) % 0xFFFF
        return b << 16 | a

    for n in (0, 1, 2, 7, 1000):
        data = random.Random(n).randbytes(n)
        assert scalars.fletcher32(data) == slow(data)
    assert int(scalars.splitmix64(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF
    assert scalars.unpack_extent(scalars.pack_extent(7, 1 << 40, 99, 3)) == (7, 1 << 40, 99, 3)
    assert scalars.pack_extent(1 << 48, 0, 0, 0) is None and scalars.pack_extent(0, 0, 0, 0x20) is None


@pytest.mark.parametrize(("k", "m"), [(2, 1), (4, 2), (5, 3)])
def test_any_k_shards_rebuild_all(k, m):
    from itertools import combinations

    data = np.frombuffer(random.Random(k).randbytes(k * 33), np.uint8).reshape(k, 33)
    full = erasure.encode(data, m)
    for keep in combinations(range(k + m), k):
        assert (erasure.reconstruct({i: full[i] for i in keep}, k, m) == full).all()
    with pytest.raises(ValueError):
        erasure.reconstruct({0: full[0]}, k, m)
    p, q = erasure.pq_parity(dict(enumerate(data)))
    assert (p == np.bitwise_xor.reduce(data)).all() and (q == np.bitwise_xor.reduce([erasure.times(d, 1 << i) for i, d in enumerate(data)])).all()


def test_zone_and_band_plans():
    a = pd.DataFrame({"file": [1, 2, 1, 1, 1], "len": [40, 10, 45, 30, 200]})
    assert planning.plan_zones(a, 3, 100)["zone"].tolist() == [0, 1, 0, 2, -1]
    assert planning.plan_bands(a, 3, 100)["zone"].tolist() == [0, 1, 0, 2, -1]


def test_tar_members():
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as tar:
        for name, kind, link in [("d", tarfile.DIRTYPE, ""), ("d/" + "n" * 150, tarfile.REGTYPE, ""), ("s", tarfile.SYMTYPE, "d"), ("h", tarfile.LNKTYPE, "s")]:
            info = tarfile.TarInfo(name)
            info.type, info.linkname = kind, link
            info.size = 5 if kind == tarfile.REGTYPE else 0
            tar.addfile(info, io.BytesIO(b"hello"))
    rows = list(archives.parse_tar(out.getvalue()))
    assert [(r[0], r[1], r[2]) for r in rows] == [("d", "dir", 0), ("d/" + "n" * 150, "file", 5), ("s", "symlink", 0), ("h", "skipped", 0)]
    bad = bytearray(out.getvalue())
    bad[3] ^= 1
    assert list(archives.parse_tar(bytes(bad)))[0][1] == "bad_header"


def test_fragments():
    raw = archives.write_fragment(1, 4, 2, b"payload")
    assert archives.read_fragment(raw) == (1, 4, 2, b"payload")
    for i in range(len(raw)):
        assert archives.read_fragment(raw[:i] + bytes([raw[i] ^ 4]) + raw[i + 1 :]) is None
    assert archives.read_fragment(b"") is None


def test_overlay_and_recovery(spark):
    base = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k long, v double")
    msg = spark.createDataFrame([(1, 5, "upsert", 11.0), (1, 6, "delete", None), (3, 1, "upsert", 3.0), (3, 2, "upsert", 4.0)], "k long, seq long, op string, v double")
    assert sorted(map(tuple, scans.merge_messages(base, msg).collect())) == [(2, 20.0), (3, 4.0)]
    tx = spark.createDataFrame([(5, 1, "a"), (6, 2, "b"), (8, 3, "c"), (9, 4, "d"), (9, 5, "again"), (2, 6, "old")], "tx_id long, pos long, payload string")
    assert sorted((r.tx_id, r.payload) for r in scans.recover_blocks(tx, 4).collect()) == [(8, "c"), (9, "d")]


def test_clamped_refcounts(spark):
    rng = random.Random(2)
    ev = [(rng.randint(0, 5), rng.choice([1, -1, -1]), i) for i in range(200)]
    want = defaultdict(int)
    for h, x, _ in ev:
        want[h] = max(0, want[h] + x)
    got = aggregates.clamped_refcount(spark.createDataFrame(ev, "h long, d long, o long"), "h", "d", "o").collect()
    assert Counter({r.h: r.refcount for r in got}) == Counter(want)
