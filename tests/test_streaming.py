"""A stream stopped and started from its checkpoint ends where one run ends."""

from collections import defaultdict

import pytest

from cairn.shared import scratch
from cairn.streaming import stateful as st

ROWS = [(i, i * 40_000, i % 3, "write", i * 37 % 900, i * 7919 % 50_000, i % 5) for i in range(120)]
SCHEMA = "seq long, t long, ns long, op string, latency_us long, bytes long, block long"
CASES = {
    "bucket": (st.bucket_step(1, 1, 60000, 10), "ns long, seq long, admitted boolean, tokens long", "b long, o long, at long"),
    "rate": (st.rate_limit_step(5), "ns long, e long", "e long"),
    "guardian": (st.guardian_step(), "ns long, seq long, size long, latency long, class long", "s long, l long, c long"),
    "commit": (st.commit_step(90_000, 4), "ns long, seq long, window long", "w long, b long, n long, closed boolean"),
}


def plain(start, step):
    state, out = defaultdict(lambda: start), []
    Row = __import__("collections").namedtuple("Row", [c.split()[0] for c in SCHEMA.split(", ")])
    for r in map(Row._make, ROWS):
        state[r.ns], emitted = step(state[r.ns], r)
        if emitted is not None:
            out.append((r.ns, *emitted))
    return sorted(out)


@pytest.mark.parametrize("name", CASES)
def test_restart(spark, name):
    (start, step), output, state = CASES[name]
    src, sink, offsets = (scratch(spark, x) for x in ("src", "sink", "offsets"))
    for part in (ROWS[:50], ROWS[50:80], ROWS[80:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got = st.drain(st.stateful(st.io_stream(spark, src), "ns", output, state, start, step), spark, offsets, sink)
    assert sorted(map(tuple, got.collect())) == plain(start, step)


def test_rows_behind_the_watermark_are_dropped(spark):
    src, sink, offsets = (scratch(spark, x) for x in ("src", "sink", "offsets"))
    day = 86400
    batches = [[(1, 20 * day)], [(2, 19 * day), (3, 20 * day)], [(4, 3 * day), (5, 19 * day + 5), (6, 21 * day)], [(7, 20 * day + 9), (8, 2 * day)]]
    for rows in batches:  # the watermark is two days behind the newest row of the batches before
        data = [(i, t, 0, "write", 1, 1, 1) for i, t in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got = st.daily_counts(st.io_stream(spark, src), "2 days", spark, offsets, sink)
    assert {r.start // day: r.ops for r in got.collect()} == {19: 2, 20: 3, 21: 1}
