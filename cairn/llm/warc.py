"""WARC archives and a globally ordered capture index by external merge.

Writing: every task writes gzip members, one a record, into files of its own, of bounded size, in the shared folder. Reading back:
archives are parsed record by record, digests are verified, and captures are sorted in bounded batches into run
files, one task an archive. Merging: runs undergo k-way loser-tree merging by URL key and timestamp. Key ranges are
merged by separate tasks, each of which finds its part of a run by binary search; more runs than the fan-in are first
merged in passes, likewise by key range, so that no pass has fewer tasks than there are ranges.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import arrow_batches, scratch, stash, workspace

FAN_IN, RUN_CAPTURES, RANGE_CAPTURES = 64, 50_000, 20_000
#: Key ranges at most (they grow instead), keys looked at for each range, tasks that read archives at most.
MAX_RANGES, KEYS_A_RANGE, READERS = 20_000, 8, 20_000
READ, ARCHIVE_BYTES = 1 << 16, 1 << 28
CAPTURE = "urlkey string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and sorted query, lower-cased; scheme, user, fragment, default ports and www. go. Never fails."""
    text = (url or "").strip()
    try:
        u = urlsplit(text if "//" in text else f"//{text}")
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return text.lower()
    query = "&".join(sorted(u.query.split("&"))) if u.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){unquote(u.path) or '/'}{'?' + query if query else ''}".lower()


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _header(value: object) -> str:
    """Header values hold no line ends."""
    return json.dumps(value, ensure_ascii=False)


def record_id(page_id: int | None, digest: str, *more: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, (page_id, digest, *more))))}>"


def record(page_id: int | None, url: str | None, timestamp: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None, refers_date: str | None = None) -> bytes:
    """One WARC 1.1 record. A revisit has no payload; its headers say which response holds it and how long it is.

    The id of a response follows from its page and payload, so revisits can name it; rows that repeat share it.
    """
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, timestamp, url) if revisit else record_id(page_id, digest)}",
        f"WARC-Date: {timestamp}",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {_header(page_id)}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Target-URI: {_header(refers_url)}"]
        lines += [f"WARC-Refers-To-Date: {refers_date}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def records(stream, chunk: int = READ) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of every gzip member; bounded by the largest record."""
    at, start, parts, z, data = 0, 0, [], zlib.decompressobj(31), b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                break
        parts.append(z.decompress(data))
        used = len(data) - len(z.unused_data)
        at, data = at + used, z.unused_data
        if z.eof:
            yield start, at - start, b"".join(parts)
            start, parts, z = at, [], zlib.decompressobj(31)
    if any(parts) or at > start:
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    payload = body[: int(fields["Content-Length"])]
    if body[len(payload) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, payload


def write_archives(pages: DataFrame, folder: str, *, id_col: str, url_col: str, payload: Column, timestamp: Column, min_revisit: int) -> DataFrame:
    """Write all records; the files that committed tasks wrote, with their number of records."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.translate(timestamp.cast("string"), "\t\r\n", "   ").alias("ts"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("n", F.octet_length("payload").cast("long"))
    # Of equal payloads the largest id is the response. Only payloads seen twice are joined; a hot one is split by AQE.
    first = rows.filter((F.col("n") >= min_revisit) & F.col("id").isNotNull()).groupBy("digest", "n").agg(F.max(F.struct("id", "url", "ts")).alias("first"), F.count(F.lit(1)).alias("c"))
    rows = rows.join(first.filter("c > 1").drop("c"), ["digest", "n"], "left")
    rows = rows.select("id", "url", "ts", "payload", "digest", F.when(F.col("id") != F.col("first.id"), F.col("first")).alias("of")).select("id", "url", "ts", "payload", "digest", "of.id", "of.url", "of.ts")
    rows = rows.toDF("id", "url", "ts", "payload", "digest", "refers_to", "refers_url", "refers_date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        name, out, n, size = "", None, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n": [n]})

        try:
            for b in batches:
                for i in range(len(b)):
                    if out is None:
                        name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0  # a retried task writes other files
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    page, url, ts, text, digest, *of = (c[i].as_py() for c in b.columns)
                    z = zlib.compressobj(3, zlib.DEFLATED, 31)
                    raw = z.compress(record(page, url, ts or "", text.encode(), digest, *of)) + z.flush()
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
                    if size >= ARCHIVE_BYTES:
                        yield closed()
                        out = None
            if out is not None:
                yield closed()
        finally:
            if out is not None:
                out.close()

    return stash(rows.mapInArrow(run, "file string, n long"), "warc-files")


def sort_key(line: bytes) -> bytes:
    """Runs hold lines `urlkey TAB timestamp TAB page TAB json`; control characters in keys are escaped, so lines sort as their keys."""
    return line.rsplit(b"\t", 1)[0]


def line_of(capture: dict) -> bytes:
    key = json.dumps(capture["urlkey"], ensure_ascii=False)[1:-1]
    page = capture["page_id"]
    place = "~" if page is None else f"{page + (1 << 63):020d}"
    rest = [capture[k] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length")]
    return f"{key}\t{capture['timestamp']}\t{place}\t{json.dumps(rest, ensure_ascii=False)}\n".encode()


def capture_of(line: bytes) -> tuple:
    key, ts, _, rest = line.decode().rstrip("\n").split("\t", 3)
    return (json.loads(f'"{key}"'), ts, *json.loads(rest))


def _write_run(folder: str, lines: Iterator[bytes]) -> tuple[str, int]:
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    name, n = f"{uuid.uuid4().hex}.run", 0
    with fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20) as out:
        for line in lines:
            out.write(line)
            n += 1
    return f"{folder}/{name}", n


def capture_runs(files: DataFrame, folder: str, run_captures: int = RUN_CAPTURES) -> DataFrame:
    """Read archives back; verify, sort bounded batches of captures, write each as a run: run, n, sample (keys evenly spaced)."""

    def captures(file: str, expected: int) -> Iterator[dict]:
        fs, path = _fs(file)
        n = 0
        with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
            for offset, length, raw in records(stream):
                head, payload = parse(raw)
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                size = int(head["X-Payload-Length"])
                if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"digest or length of the record at {offset} of {file} differs")
                url = json.loads(head["WARC-Target-URI"])
                refers = head.get("X-Refers-To-Page")
                n += 1
                yield {"urlkey": url_key(url), "timestamp": head["WARC-Date"], "page_id": json.loads(head["X-Page-Id"]), "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None, "file": file, "offset": offset, "length": length}
        if n != expected:
            raise ValueError(f"{file} has {n} records of {expected}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            held.sort(key=sort_key)
            path, n = _write_run(folder, held)
            sample = [sort_key(held[i]) for i in range(0, n, max(1, n // 64))]
            held.clear()
            return pa.RecordBatch.from_pydict({"run": [path], "n": [n], "sample": pa.array([sample], pa.list_(pa.binary()))})

        for b in batches:
            for file, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for c in captures(file, n):
                    held.append(line_of(c))
                    if len(held) >= run_captures:
                        yield flush()
        if held:
            yield flush()

    # A given number of tasks, as an engine that goes by bytes would put the few short rows into one.
    spread = files.repartition(max(1, min(files.count(), READERS)))
    return stash(spread.mapInArrow(run, "run string, n long, sample array<binary>"), "warc-runs")


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, so the next winner costs one path to the root."""

    def __init__(self, streams: list[Iterator[bytes]], key: Callable[[bytes], bytes] = sort_key):
        self.streams, self.key, self.k = streams, key, len(streams)
        self.heads: list[tuple[bytes, int, bytes] | None] = [None] * self.k
        for i in range(self.k):
            self._advance(i)
        self.losers = [-1] * max(1, self.k)
        self.winner = self._build(1) if self.k else -1

    def _advance(self, i: int) -> None:
        line = next(self.streams[i], None)
        self.heads[i] = None if line is None else (self.key(line), i, line)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._less(b, a):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[bytes]:
        while self.k and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][2]
            self._advance(i)
            node = (i + self.k) // 2
            while node:
                if self._less(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def read_run(path: str, lo: bytes | None = None, hi: bytes | None = None) -> Iterator[bytes]:
    """The lines of a run with lo <= key < hi, found by binary search and read in small buffers."""
    fs, name = _fs(path)
    with fs.open_input_file(name) as f:
        at, end = 0, f.size()
        if lo is not None:
            a, b = 0, end  # the first line at or after lo begins in [a, b]
            while b - a > READ:
                m = (a + b) // 2
                start, line = _line_after(f, m, end)
                if line is None or sort_key(line) >= lo:
                    b = m
                else:
                    a = start + len(line)
            at = a
        f.seek(at)
        rest = b""
        while True:
            data = f.read(READ)
            if not data:
                return
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            for line in lines:
                key = sort_key(line)
                if hi is not None and key >= hi:
                    return
                if lo is None or key >= lo:
                    yield line + b"\n"


def _line_after(f, at: int, end: int) -> tuple[int, bytes | None]:
    """Start and text of the first whole line that begins after `at`."""
    f.seek(at)
    data = f.read(READ)
    while b"\n" not in data or b"\n" not in data[data.index(b"\n") + 1 :]:
        more = f.read(READ)
        if not more:
            break
        data += more
    i = data.find(b"\n")
    if i < 0 or at + i + 1 >= end:
        return end, None
    return at + i + 1, data[i + 1 : data.find(b"\n", i + 1) + 1]


def key_ranges(runs: DataFrame, range_captures: int) -> list[tuple[int, bytes | None, bytes | None]]:
    """(number, lo, hi): ranges of about equal numbers of captures, at most MAX_RANGES, cut at sampled keys."""
    total, keys = runs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("sample")), F.lit(0))).first()
    parts = min(MAX_RANGES, max(1, -(-total // range_captures)))
    share = min(1.0, KEYS_A_RANGE * parts / max(1, keys))
    sampled = runs.select(F.explode("sample").alias("k")).filter(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    keys = sorted(bytes(r["k"]) for r in sampled.collect())  # about KEYS_A_RANGE * MAX_RANGES at most
    cuts = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []
    return list(zip(range(len(cuts) + 1), [None, *cuts], [*cuts, None], strict=True))


def ranged_work(segments: DataFrame, ranges: list[tuple], step: int) -> DataFrame:
    """(g, range, lo, hi, runs): for each group and each `step` key ranges the run files that hold them; names only.

    segments (g, first, step, run): a run file holds the key ranges from `first` on, `step` of them, an aligned power of two.
    """
    cut = [(i // step, ranges[i][1], ranges[min(i + step, len(ranges)) - 1][2]) for i in range(0, len(ranges), step)]
    bounds = F.broadcast(segments.sparkSession.createDataFrame(cut, "range int, lo binary, hi binary"))  # at most MAX_RANGES rows
    last = F.least(F.col("first") + F.col("step"), F.lit(len(ranges))) - 1
    held = segments.select("g", "run", F.explode(F.sequence(F.expr(f"first div {step}").cast("int"), F.floor(last / step).cast("int"))).alias("range"))
    return held.groupBy("g", "range").agg(F.sort_array(F.collect_list("run")).alias("runs")).join(bounds, "range").select("g", "range", "lo", "hi", "runs")


def merge_runs(runs: DataFrame, folder: str, fan_in: int = FAN_IN, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """All captures in global order of URL key, timestamp, page: the partitions hold the key ranges in order, merged.

    A pass merges groups of `fan_in` runs, each group in as many key ranges as give tasks of about one range's size.
    """
    ranges = key_ranges(runs, range_captures)
    n_runs = runs.count()
    whole = 1 << (len(ranges) - 1).bit_length()
    segments = runs.select(F.col("run").alias("name"), F.lit(0).alias("first"), F.lit(whole).alias("step"), "run")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, number, lo, hi, paths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                path, _ = _write_run(folder, LoserTree([read_run(p, lo, hi) for p in paths]))
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([number], pa.int32()), pa.array([path])], names=["name", "range", "run"])

    while n_runs > fan_in:
        # Runs are numbered within buckets of bounded size, and a group is `fan_in` neighbours.
        names = segments.select("name").distinct().withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(-(-n_runs // 4096))))
        numbered = names.withColumn("i", F.row_number().over(Window.partitionBy("bucket").orderBy("name")) - 1)
        dealt = stash(numbered.select("name", F.concat_ws("-", "bucket", F.floor(F.col("i") / fan_in)).alias("g")), "warc-groups")
        n_runs = dealt.select("g").distinct().count()
        wanted = -(-len(ranges) // n_runs)  # of a group, so that its tasks are of a range's size
        step = min(whole, 1 << (-(-len(ranges) // wanted) - 1).bit_length())
        tasks = ranged_work(segments.join(dealt, "name"), ranges, step)
        tasks = tasks.repartition(min(READERS, n_runs * -(-len(ranges) // step)))
        merged = stash(tasks.mapInArrow(merge, "name string, range int, run string"), "warc-runs")
        segments = merged.select("name", (F.col("range") * step).alias("first"), F.lit(step).alias("step"), "run")
    work = ranged_work(segments.withColumn("g", F.lit("")), ranges, 1)
    work = stash(work.select("range", "lo", "hi", "runs"), "warc-ranges", keep=True)
    spark = runs.sparkSession
    schema = spark.createDataFrame([], CAPTURE).schema
    names = schema.names

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, lo, hi, paths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held = []
                for line in LoserTree([read_run(p, lo, hi) for p in sorted(paths)]):
                    held.append(capture_of(line))
                    if len(held) >= 2000:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    kinds = [pa.int64() if f.dataType.typeName() == "long" else pa.string() for f in schema]
    return work.repartitionByRange(len(ranges), "range").sortWithinPartitions("range").mapInArrow(run, schema)


def capture_index(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", timestamp: Column | None = None, min_revisit: int = 1000, fan_in: int = FAN_IN, run_captures: int = RUN_CAPTURES) -> DataFrame:
    """Archive all pages and return the merged index: one row per page in global order, each pointing at its record.

    Null payloads are empty, null URLs have the key of the empty URL and null ids stay null; they never are the
    response of others. Equal payloads of at least min_revisit bytes: the largest id is the response, the others
    revisit it; rows that repeat the largest id are all responses. An empty table gives an empty index.
    Archives and the runs that the index is merged from stay in the shared folder.
    timestamp: text that sorts by time; default: the id, in seconds from 2024.
    """
    folder = scratch(pages.sparkSession, "warc")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'") if timestamp is None else timestamp
    with workspace(pages.sparkSession), arrow_batches(pages.sparkSession):
        files = write_archives(pages, folder, id_col=id_col, url_col=url_col, payload=F.coalesce(F.col(html_col), F.lit("")), timestamp=stamp, min_revisit=min_revisit)
        return merge_runs(capture_runs(files, f"{folder}/runs", run_captures), f"{folder}/runs", fan_in)
