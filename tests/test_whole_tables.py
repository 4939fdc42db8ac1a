"""The queries over whole tables: every row gets its result, checked against plain Python where there is no SQL."""

from collections import Counter

import pandas as pd

from cairn.operators import aggregates
from cairn.plans import registry
from tests.test_golden import slow_fastcdc

SF = "/root/testdata/sf0.001"


def texts():
    docs = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return {int(i): (x or "").encode() for i, x in zip(docs["doc_id"], docs["text"], strict=True)}


def whole(spark, name):
    return registry.queries()[name](spark, SF).collect()


def slow_entropy(data):
    def log2(x):
        f = x.bit_length() - 1
        return (f << 16) + aggregates.LOG2_FRACTIONS[min(15, (x - (1 << f)) * 16 >> f)]

    n = len(data)
    return min(8 << 32, sum(((c << 32) // n) * (log2(n) - log2(c)) >> 16 for c in Counter(data).values()))


def test_entropy_of_every_text(spark):
    got = {r.doc_id: r.entropy for r in whole(spark, "a5_byte_entropy")}
    assert got == {i: slow_entropy(x) for i, x in texts().items() if x}
    assert len(got) > 60


def test_chunks_of_every_text(spark):
    (row,) = whole(spark, "e9_table_function_addition")
    cut = [slow_fastcdc(x, 2048, 8192, 32768) for x in texts().values() if x]
    assert (row.chunks, row.bytes) == (sum(map(len, cut)), sum(map(sum, cut)))
    assert row.chunks > len(cut)  # some text is long enough to be cut


def test_every_object_and_event(spark):
    assert {r.doc_id for r in whole(spark, "x21_aes_round_trip")} == set(texts())
    events = pd.read_parquet(f"{SF}/events.parquet", columns=["event_id"])
    assert {r.event_id for r in whole(spark, "x23_builtins_addition")} == set(events["event_id"])


def test_every_line_is_placed(spark):
    lines = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_suppkey"])
    want = Counter(lines["l_suppkey"] % 25)
    for name in ("w20_zone_append", "w21_band_assignment"):
        assert Counter(r.device for r in whole(spark, name)) == want


def test_ancestors_of_every_order(spark):
    orders = pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderkey", "o_custkey"])
    want = {}
    for _, g in orders.groupby("o_custkey"):
        keys = sorted(map(int, g["o_orderkey"]))
        want |= {k: (i, keys[0]) for i, k in enumerate(keys) if i}
    assert {r.start: (r.ancestors, r.oldest) for r in whole(spark, "j14_ancestry")} == want


def test_snapshot_of_every_line(spark):
    from bisect import bisect_right

    from cairn.sources import fixtures as fx

    by = {}
    for r in fx.snapshots(spark, SF).collect():
        by.setdefault(r.id % 32, []).append((r["at"], r.id))
    times = {k: sorted({a for a, _ in v}) for k, v in by.items()}
    least = {k: {a: min(i for b, i in v if b == a) for a, _ in v} for k, v in by.items()}
    lines = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_shipdate"])
    want = set()
    for k, n, at in zip(lines["l_orderkey"], lines["l_linenumber"], pd.to_datetime(lines["l_shipdate"]), strict=True):
        r, ts = int(k) % 32, int(at.timestamp())
        i = bisect_right(times.get(r, []), ts)
        want.add((r, int(k) * 10 + int(n), ts, least[r][times[r][i - 1]] if i else None))
    got = whole(spark, "j3_snapshot_as_of")
    assert {(r.r, r.pid, r.ts, r.snapshot) for r in got} == want and len(got) == len(want)


def test_statfs_of_a_full_volume(spark, tmp_path):
    """More blocks used than the volume has, and no files at all: free is what the SQL says."""
    import duckdb
    from tests.oracle import compare

    def tables(name, times, customers):
        d = tmp_path / name
        d.mkdir()
        for t in "region nation supplier part lineitem events documents embeddings pages benchmark labels conversations".split():
            (d / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
        con = duckdb.connect()
        con.execute(f"COPY (SELECT * REPLACE (o_totalprice * {times} AS o_totalprice) FROM '{SF}/orders.parquet') TO '{d}/orders.parquet' (FORMAT parquet)")
        con.execute(f"COPY (SELECT * FROM '{SF}/customer.parquet' WHERE {customers}) TO '{d}/customer.parquet' (FORMAT parquet)")
        return str(d)

    sql = registry.oracle_sql()["e7_statfs"]
    full = tables("full", 10_000, "true")
    compare(spark, registry.queries()["e7_statfs"], sql, full)
    (row,) = registry.queries()["e7_statfs"](spark, full).collect()
    assert row.free < 0
    compare(spark, registry.queries()["e7_statfs"], sql, tables("none", 1, "false"))
