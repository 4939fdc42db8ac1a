import gzip
import hashlib
import heapq
import io
import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, n long, ts string"


def pages(seed=3, n=80):
    rng = random.Random(seed)
    same = "<p>" + "x" * 1200
    out = [(0, None, None, "clash", 1, "t"), (1, "", "", "c", 1, "t"), (2, "not a url\r\nWARC-Type: x", "é\r\n\r\nWARC/1.1\r\n", "c", 1, "t"), (3, "http://[bad", "<p>ü" * 900, "c", 1, "t")]
    for i in range(4, n):
        html = same if i % 3 == 0 else "short" if i % 3 == 1 else f"<p>{rng.random()}" * rng.randint(1, 200)
        out.append((i, f"https://www.h{rng.randint(0, 5)}.example.com:443/{rng.randint(0, 9)}?b=2&a=1#f", html, "c", 1, "t"))
    return out + [(None, "http://a.example/", same, "c", 1, "t"), out[6], out[6]]


def brute(data):
    """Digest and length groups: the largest id answers."""
    first = {}
    for i, _, html, *_ in data:
        if i is not None:
            raw = (html or "").encode()
            first[raw] = max(first.get(raw, i), i)
    out = []
    for i, _, html, *_ in data:
        raw = (html or "").encode()
        ref = first.get(raw) if len(raw) >= 1000 and sum((x[2] or "").encode() == raw for x in data) > 1 else None
        revisit = i is not None and ref is not None and ref != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", ref if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fan_in", "run_captures"), [(64, 50_000), (2, 4)])
def test_round_trip_and_order(spark, fan_in, run_captures):
    data = pages()
    df = spark.createDataFrame(data, SCHEMA)
    index = warc.capture_index(df, fan_in=fan_in, run_captures=run_captures)
    got = index.collect()
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == brute(data)
    keys = [(r.urlkey, r.timestamp) for r in got]
    assert keys == sorted(keys, key=lambda k: (k[0].encode(), k[1])), "partitions follow each other in global order"
    for r in got:  # every entry points at its record
        fs, path = warc._fs(r.file)
        with fs.open_input_file(path) as f:
            f.seek(r.offset)
            head, payload = warc.parse(gzip.decompress(f.read(r.length)))
        assert head["WARC-Payload-Digest"] == f"sha1:{r.payload_digest}" and (r.record_type == "revisit" or len(payload) == r.payload_bytes)


def test_archives_are_read_by_as_many_tasks(spark, tmp_path, monkeypatch):
    """Reading back and every merge pass are dealt out, whatever the size of the tables that list the files."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    df = spark.createDataFrame(pages(n=200), SCHEMA)
    with warc.workspace(spark):
        files = warc.write_archives(df, f"file://{tmp_path}", id_col="page_id", url_col="url", payload=F.coalesce("html", F.lit("")), timestamp=F.lit("t"), min_revisit=10**9)
        spread = files.repartition(max(1, min(files.count(), warc.READERS)))
        runs = warc.capture_runs(files, f"file://{tmp_path}/runs", 3)
        out = warc.merge_runs(runs, f"file://{tmp_path}/runs", fan_in=4, range_captures=20)
        assert spread.rdd.getNumPartitions() == files.count() >= 8 and runs.count() > 60
        assert out.rdd.getNumPartitions() >= 8
        got = out.collect()
        assert [(r.urlkey, r.timestamp) for r in got] == sorted((r.urlkey, r.timestamp) for r in got) and len(got) == 203


def test_revisits_name_their_response():
    raw = warc.record(7, "http://a/", "t1", b"abc" * 500, "d", 9, "http://b/", "t2")
    head, payload = warc.parse(raw)
    other, _ = warc.parse(warc.record(9, "http://b/", "t2", b"abc" * 500, "d", None))
    assert payload == b"" and head["WARC-Refers-To"] == other["WARC-Record-ID"] != head["WARC-Record-ID"]
    assert (head["WARC-Refers-To-Target-URI"], head["WARC-Refers-To-Date"]) == ('"http://b/"', "t2")


def test_empty_table(spark):
    assert warc.capture_index(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damage_is_found():
    raw = warc.record(1, "http://a/", "t", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    z = gzip.compress(raw)
    assert [r for *_, r in warc.records(io.BytesIO(z * 3), 7)] == [raw] * 3
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(z[:-9])))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_equals_heap_merge(k):
    rng = random.Random(k)
    runs = [sorted(b"%03d\t%d" % (rng.randint(0, 40), i) for _ in range(rng.randint(0, 30))) for i in range(k)]
    got = list(warc.LoserTree([iter(r) for r in runs]))
    assert [warc.sort_key(x) for x in got] == [warc.sort_key(x) for x in heapq.merge(*runs, key=warc.sort_key)]


def test_runs_are_cut_by_binary_search(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ", 64)
    lines = [b"%05d\tp\trest%s\n" % (i // 3, b"x" * (i % 50)) for i in range(600)]
    path, _ = warc._write_run(f"file://{tmp_path}", lines)
    for lo, hi in [(None, None), (b"00010\tp", b"00011\tp"), (b"00000", b"00150"), (b"00199\tp", None), (b"00500", None), (b"00100\tp", b"00100\tp")]:
        want = [x for x in lines if (lo is None or warc.sort_key(x) >= lo) and (hi is None or warc.sort_key(x) < hi)]
        assert list(warc.read_run(path, lo, hi)) == want


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert warc.url_key("https://u@b.example.org:8443") == "org,example,b:8443)/"
    assert warc.url_key(None) == ")/"
