"""Operators without SQL, and plans whose SQL does not show how they run, against second versions in plain Python."""

import hashlib
import hmac
import io
import random
import struct
import tarfile
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from cairn.functions import erasure, scalars
from cairn.operators import coverage, ordered, planning, timeline
from cairn.plans import registry
from cairn.shared import arrow_batches, scratch
from cairn.sources import archives
from cairn.sources import fixtures as fx
from tests.test_golden import slow_fastcdc

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def texts():
    docs = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang"])
    return {int(i): ((x or "").encode(), lang) for i, x, lang in zip(docs["doc_id"], docs["text"], docs["lang"], strict=True)}


@pytest.mark.parametrize("batch", [3, 1000])
def test_carried_state_crosses_batches(spark, batch):
    rng = random.Random(batch)
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, i long, x long")
    with arrow_batches(spark, batch):
        step = lambda s, i, x: ((s[0] * 3 + x) % 1000, s[1] + 1)
        each = ordered.scan_in_order(df, ["k"], ["i"], ["x"], (0, 0), lambda s, i, x: (step(s, i, x),) * 2, "a long, n long").collect()
        last = ordered.fold_in_order(df, ["k"], ["i"], ["x"], (0, 0), step, "a long, n long").collect()
    want, state = set(), {}
    for k, i, x in rows:
        state[k] = step(state.get(k, (0, 0)), i, x)
        want.add((k, i, x, *state[k]))
    assert set(map(tuple, each)) == want and len(each) == len(rows)
    assert sorted(map(tuple, last), key=repr) == sorted(((k, *s) for k, s in state.items()), key=repr)
    assert ordered.fold_in_order(df.limit(0), ["k"], ["i"], ["x"], (0, 0), step, "a long, n long").count() == 0


def test_one_key_with_all_rows_takes_linear_time(spark):
    import time

    def took(n):
        df = spark.range(n).select(F.lit(1).alias("ns"), F.col("id").alias("t"), F.col("id").alias("seq"), F.lit(7).cast("long").alias("bytes"))
        start, step = ordered.token_bucket(1, 1, 100, 10)
        began = time.perf_counter()
        assert ordered.scan_in_order(df, ["ns"], ["t", "seq"], ["bytes"], start, step, "ok boolean, left long").count() == n
        return time.perf_counter() - began

    took(1000)
    assert took(200_000) < 20


def test_online_weights(spark):
    want = {}
    for r in sorted(fx.io_ops(spark, SF).collect(), key=lambda r: r.seq):
        w0, w1 = want.get(r.ns % 16, (1.0, -0.05))
        x = r.block / 50.0
        err = r.latency_us / 10000.0 + w0 + w1 * x
        want[r.ns % 16] = tuple(max(-50.0, min(50.0, v)) for v in (w0 - 0.01 * err, w1 - 0.01 * err * x))
    got = {r.g: (r.w0, r.w1) for r in run(spark, "w7_online_weights")}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], abs=1e-8) for g in want)


def test_compression(spark):
    docs = texts()
    for r in run(spark, "x20_compression"):
        raw = docs[r.doc_id][0]
        sizes = {"zstd": len(zstandard.ZstdCompressor(level=3).compress(raw)), "deflate": len(zlib.compress(raw, 6)), "raw": len(raw)}
        assert r.raw == len(raw) and r["size"] == min(sizes.values()) and sizes[r.codec] == r["size"]


def test_chunk_statistics(spark):
    seen, lens = Counter(), {}
    for raw, lang in texts().values():
        at = 0
        for n in slow_fastcdc(raw, 256, 1024, 4096) if raw else []:
            key = (lang, raw[at : at + n])
            seen[key] += 1
            lens[key] = n
            at += n
    for r in run(spark, "a1_cdc_dedup"):
        mine = [k for k in seen if k[0] == r.domain]
        logical, stored = sum(seen[k] * lens[k] for k in mine), sum(lens[k] for k in mine)
        assert (r.chunks, r.logical, r.unique, r.stored, r.eliminated) == (sum(seen[k] for k in mine), logical, len(mine), stored, logical - stored)
        assert (r.least, r.greatest) == (min(lens[k] for k in mine), max(lens[k] for k in mine)) and r.ratio == pytest.approx(logical / stored, abs=1e-8)


def test_hashes(spark):
    docs = texts()
    assert {r.doc_id: r.crc for r in run(spark, "x1_crc32")} == {i: zlib.crc32(x) for i, (x, _) in docs.items()}
    assert {r.doc_id: r.xxh64 for r in run(spark, "x2_xxhash64")} == {i: xxhash.xxh64(x, 0).hexdigest() for i, (x, _) in docs.items()}

    def fletcher(x):
        a = b = 0xFFFF
        for (w,) in struct.iter_unpack("<H", x + b"\0" * (len(x) % 2)):
            a = (a + w) % 0xFFFF
            b = (b + a) % 0xFFFF
        return b << 16 | a

    assert {r.doc_id: r.fletcher % 0xFFFF for r in run(spark, "x5_fletcher32")} == {i: fletcher(x) % 0xFFFF for i, (x, _) in docs.items()}
    names = dict(zip(*(pd.read_parquet(f"{SF}/part.parquet")[c] for c in ("p_partkey", "p_name")), strict=True))
    assert {r.p_partkey: (r["hash"], r.bucket) for r in run(spark, "x6_fnv1a")} == {k: (f"{scalars.fnv1a64(n.encode()):016x}", scalars.fnv1a64(n.encode()) % 64) for k, n in names.items()}
    odd = pd.Series([b"", b"a", b"\xff" * 300, b"ab"])
    assert scalars.fnv1a64_all(odd).tolist() == [scalars.fnv1a64(x) for x in odd]
    for r in run(spark, "x7_splitmix_shard")[:50]:
        assert r.shard == int(scalars.splitmix64(np.array([r.p_partkey], np.uint64))[0]) & 15


def test_packed_extents(spark):
    length = {(r.file, r.logical, r.physical): set() for r in fx.extents(spark, SF).collect()}
    for r in fx.extents(spark, SF).collect():
        length[r.file, r.logical, r.physical].add(scalars.pack_extent(r.logical, r.physical, r.length, 1).hex())
    for r in run(spark, "x13_extent_codec"):
        assert r.packed in length[r.file, r.logical, r.physical]


def test_stripes(spark):
    part = pd.read_parquet(f"{SF}/part.parquet").sort_values("p_partkey")
    groups = {int(g): erasure.padded([n.encode() for n in x["p_name"]]) for g, x in part.groupby(part["p_partkey"] // 4)}
    with arrow_batches(spark, 5):  # stripes that begin in one batch and end in the next
        got = {r.g: r for r in run(spark, "a20_parity_encode")}
        back = {r.g: r for r in run(spark, "a21_rs_reconstruct")}
        read = {r.g: r for r in run(spark, "s14_ec_fragments")}
    assert set(got) == set(back) == set(read) == set(groups)
    for g, s in groups.items():
        p, q = erasure.pq_parity(dict(enumerate(s)))
        c = erasure.encode(s, 2)[len(s) :]
        assert (got[g].p, got[g].q, got[g].c0, got[g].c1) == tuple(x.tobytes().hex() for x in (p, q, *c))
        assert back[g].restored and back[g].lost == len({g % (len(s) + 2), g // 7 % (len(s) + 2)})
        assert read[g].restored and read[g].good == len(s) + 1


def test_damage_beyond_repair_shows():
    full = erasure.coded(erasure.generator(3, 2), np.random.default_rng(1).integers(0, 256, (3, 6, 10), dtype=np.uint8))
    with pytest.raises(ValueError):
        erasure.restored(full, 3, 2, [{0, 1, 2}] * 6)
    wrong = full.copy()
    wrong[4, 2, 3] ^= 1
    same = (erasure.restored(wrong, 3, 2, [{0}] * 6) == full).all(axis=(0, 2))
    assert same.tolist() == [True] * 6, "the damaged shard is not among the survivors used"


def test_tar_headers():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as tar:
        for n in ("one", "two"):
            info = tarfile.TarInfo(n)
            info.size = 700
            tar.addfile(info, io.BytesIO(b"z" * 700))
    raw = bytearray(out.getvalue())

    def resealed(b):
        b[148:156] = b" " * 8
        b[148:156] = b"%06o\0 " % sum(b[:512])
        return b

    assert archives.number(b"0000017\0") == 15 and archives.number(b"\x80" + bytes(10) + b"\x01") == 1 and archives.number(b"00x9") is None
    wide = bytearray(raw)
    wide[124:136] = b"\x80" + (700).to_bytes(11, "big")  # base 256
    assert [r[:3] for r in archives.parse_tar(bytes(resealed(wide)))] == [("one", "file", 700), ("two", "file", 700)]
    odd = bytearray(raw)
    odd[124:136] = b"not a size \0"
    assert [r[1] for r in archives.parse_tar(bytes(resealed(odd)))] == ["bad_header"]
    assert [r[1] for r in archives.parse_tar(bytes(raw[: 512 * 4 + 20]))] == ["file", "truncated"]


def test_tar_archives_are_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE", 2000)
    assert len(run(spark, "s12_tar_import")) == len(texts())


def test_damaged_manifest_is_refused(spark):
    f = fx.files(spark, SF)
    path = scratch(spark, "test-snapshot")
    archives.send_snapshot(f, path)
    assert {r.status for r in archives.receive_snapshot(spark, path).collect()} == {"ok"}
    short = spark.read.parquet(f"{path}/manifest").limit(100).cache()
    short.count()
    short.write.mode("overwrite").parquet(f"{path}/manifest2")
    other = scratch(spark, "test-damaged")
    f.select("path", "text").write.parquet(f"{other}/data")
    short.write.parquet(f"{other}/manifest")
    spark.read.parquet(f"{path}/footer").write.parquet(f"{other}/footer")
    with pytest.raises(ValueError, match="footer"):
        archives.receive_snapshot(spark, other)


def test_ancestry_of_trees(spark):
    rng = random.Random(3)
    parent = {0: None} | {i: rng.choice([i - 1, rng.randrange(i), None]) for i in range(1, 300)}
    want = {}
    for i in parent:
        n, at = 0, i
        while parent[at] is not None:
            n, at = n + 1, parent[at]
        if n:
            want[i] = (n, at)
    got = timeline.ancestry(spark.createDataFrame(list(parent.items()), "node long, parent long")).collect()
    assert {r.node: (r.ancestors, r.oldest) for r in got} == want and len(got) == len(want)
    assert timeline.ancestry(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_running_sums_in_ranges(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 5), rng.randint(1, 9)) for i in range(1000)]
    got = planning.running_sum(spark.createDataFrame(rows, "k long, g long, n long").repartition(7), [F.desc("g"), F.col("k")], "n", "s").collect()
    upto, want = 0, {}
    for k, _, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        upto += n
        want[k] = upto
    assert {r.k: r.s for r in got} == want


def greedy(devices, budget):
    """Sources and destinations walked by two pointers."""
    used, cap = sum(d["used"] for d in devices), sum(d["capacity"] for d in devices if not d["leaving"])
    target = {d["device"]: 0 if d["leaving"] else d["capacity"] * used // cap * (10000 - planning.DRAIN_BPS[d["band"]]) // 10000 for d in devices}
    src = sorted(([d["device"], d["used"] - target[d["device"]], d["leaving"]] for d in devices if d["used"] > target[d["device"]]), key=lambda x: (not x[2], -x[1], x[0]))
    dst = sorted(([d["device"], target[d["device"]] - d["used"]] for d in devices if d["used"] < target[d["device"]] and not d["leaving"]), key=lambda x: (-x[1], x[0]))
    out = []
    while src and dst and budget:
        n = min(src[0][1], dst[0][1], budget)
        out.append((src[0][0], dst[0][0], n))
        budget -= n
        src[0][1] -= n
        dst[0][1] -= n
        src, dst = src[not src[0][1] :], dst[not dst[0][1] :]
    return target, out


def test_rebalance_moves_and_loop(spark, monkeypatch):
    devices = [r.asDict() for r in fx.devices(spark, "/root/testdata/sf0.01").collect()]
    df = spark.createDataFrame(devices, "device long, capacity long, used long, band long, leaving boolean")
    plans, stash = [], planning.stash
    monkeypatch.setattr(planning, "stash", lambda x, *a, **k: (plans.append(x._jdf.queryExecution().executedPlan().toString()), stash(x, *a, **k))[1])
    for budget in (1, 5000, 10**9):
        got = planning.rebalance_moves(planning.rebalance_targets(df), budget)
        assert sorted(map(tuple, got.collect())) == sorted(greedy(devices, budget)[1])
    joins = [p for p in plans if "lo_s" in p and "lo_d" in p]
    assert joins and not any("NestedLoop" in p or "Cartesian" in p for p in joins)
    out, rounds = planning.rebalance_loop(df, 100_000, 3)
    state, done = [dict(d) for d in devices], 0

    def balanced(d, target):
        return d["used"] == 0 if d["leaving"] else abs(d["used"] - target[d["device"]]) <= max(d["capacity"] // 100, 1)

    moved = None
    while done < 3:
        target, moves = greedy(state, 100_000)
        if all(balanced(d, target) for d in state) or moved == 0:
            break
        for a, b, n in moves:
            for d in state:
                d["used"] += n * ((d["device"] == b) - (d["device"] == a))
        moved, done = len(moves), done + 1
    assert rounds == done and {r.device: r.used for r in out.collect()} == {d["device"]: d["used"] for d in state}


def test_collection_loop(spark):
    rows = [(i, 100, (i * 37) % 101, 1000 * i, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "segment long, total long, live long, age_s long, cycles long")
    out, rounds = planning.gc_loop(df, 0, 6000, 86400, 4)
    left = out.collect()
    assert sum(r.live for r in left) == sum(r[2] for r in rows), "collecting moves live bytes and loses none"
    assert 1 <= rounds <= 4 and (sum(r.total for r in left) * 4 <= 6000 * 3 or rounds == 4)
    nothing, rounds = planning.gc_loop(df.withColumn("live", F.col("total")), 0, 6000, 86400, 4)
    assert rounds == 0 and nothing.count() == 60


def test_derived_keys(spark):
    ikm, salt, info = bytes([11] * 22), bytes(range(13)), bytes(range(0xF0, 0xFA))
    assert scalars.hkdf_sha256(ikm, info, 42, salt).hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"  # RFC 5869, first case
    assert scalars.pbkdf2_sha256(b"passwd", b"salt", 1, 64).hex().startswith("55ac046e56e3089fec1691c22544b605")  # RFC 7914
    assert scalars.pbkdf2_sha256(b"x", b"y", 0, 32) is None and scalars.pbkdf2_sha256(b"x", b"y", 1, 32 * 255 + 1) is None
    names = dict(zip(*(pd.read_parquet(f"{SF}/supplier.parquet")[c] for c in ("s_suppkey", "s_name")), strict=True))
    got = run(spark, "x21_key_derivation")
    assert len(got) == len(names) and len({r.domain for r in got}) == len(names)
    prk = hmac.new(bytes(32), bytes(range(32)), hashlib.sha256).digest()
    for r in got:
        n = names[r.s_suppkey].encode()
        assert r.domain == hmac.new(prk, scalars.DOMAIN_INFO + n + b"\x01", hashlib.sha256).hexdigest()
        assert r.wrapped == hashlib.pbkdf2_hmac("sha256", n, b"salt" + n, 50, 32).hex()


def test_recovery_goes_through_its_steps_in_order(spark):
    class Backend:
        def __init__(self, copies):
            self.copies, self.calls = copies, []

        def probe(self):
            return spark.createDataFrame(self.copies, "copy long, generation long, valid boolean")

        def replay(self, generation):
            self.calls.append(("replay", generation))
            return 3, 1

        def checkpoint(self, generation):
            self.calls.append(("checkpoint", generation))

        def reconcile(self):
            self.calls.append(("reconcile",))
            return 2, 5

        def go_writable(self):
            self.calls.append(("writable",))

    b = Backend([(0, 9, False), (1, 7, True), (2, 7, True)])
    assert coverage.recover(b) == [("probe", 1, 7), ("replay", 3, 1), ("checkpoint", 8, 0), ("reconcile", 2, 5), ("writable", 0, 0)]
    assert b.calls == [("replay", 7), ("checkpoint", 8), ("reconcile",), ("writable",)]
    with pytest.raises(ValueError):
        coverage.recover(Backend([(0, 9, False)]))
