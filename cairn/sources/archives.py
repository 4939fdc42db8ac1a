"""Byte-level sources and sinks: tar import, erasure-coded fragments, snapshot streams, chunked writes, capability tokens."""

from __future__ import annotations

import hashlib
import hmac
import io
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.chunking import chunks, fastcdc
from cairn.functions.erasure import by_stripe, coded, generator, restored
from cairn.operators.ordered import fold_in_order
from cairn.operators.timeline import verify_manifest
from cairn.plans.registry import query
from cairn.shared import scratch
from cairn.sources import fixtures as fx
from cairn.sources.fixtures import t

BLOCK = 512
#: Bytes of text after which an archive is closed.
ARCHIVE = 4 << 20


def number(field: bytes) -> int | None:
    """A number of a tar header: octal digits, or base 256 if its first bit is set; None if it is neither."""
    if field[:1] >= b"\x80":
        return int.from_bytes(bytes([field[0] & 127]) + field[1:], "big")
    digits = field.strip(b"\0 ")
    return int(digits or b"0", 8) if all(48 <= c < 56 for c in digits) else None


def parse_tar(data: bytes) -> Iterator[tuple[str, str, int, str, str]]:
    """(path, kind, size, digest, target) of ustar members. A header whose checksum or numbers are wrong, or a member that ends
    beyond the archive, ends it with an error row; GNU long names are honoured; hard links, devices and extended headers are reported as skipped."""
    at, long_name = 0, None
    while at + BLOCK <= len(data):
        h = data[at : at + BLOCK]
        if not h.strip(b"\0"):
            return
        if number(h[148:156]) != sum(h[:148]) + 256 + sum(h[156:]) or number(h[124:136]) is None:
            yield "", "bad_header", at, "", ""
            return
        text = lambda a, b: h[a:b].split(b"\0")[0].decode("utf-8", "replace")
        size, kind = number(h[124:136]), h[156:157]
        if at + BLOCK + size > len(data):
            yield text(0, 100), "truncated", at, "", ""
            return
        body = data[at + BLOCK : at + BLOCK + size]
        at += BLOCK + -(-size // BLOCK) * BLOCK
        if kind == b"L":
            long_name = body.rstrip(b"\0").decode("utf-8", "replace")
            continue
        prefix = text(345, 500) if h[257:262] == b"ustar" and h[262:263] == b"\0" else ""
        path = long_name or (f"{prefix}/" if prefix else "") + text(0, 100)
        long_name = None
        if kind in (b"0", b"\0"):
            yield path, "file", size, hashlib.sha256(body).hexdigest(), ""
        elif kind == b"5":
            yield path.rstrip("/"), "dir", 0, "", ""
        elif kind == b"2":
            yield path, "symlink", 0, "", text(157, 257)
        else:
            yield path, "skipped", size, "", ""


def import_tars(archives: DataFrame, data_col: str) -> DataFrame:
    """Members of every archive (one per row, binary column). Archives are independent; a row's archive is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                if rows := list(parse_tar(raw.as_py() or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "kind", "size", "digest", "target"])

    return archives.select(data_col).mapInArrow(run, "path string, kind string, size long, digest string, target string")


def _tar_of(names: tuple[str, ...], texts: tuple[str, ...]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as tar:
        for name, text in zip(names, texts, strict=True):
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


@query(f"WITH {fx.FILES} SELECT substr(path, 2) AS path, 'file' AS kind, size, digest FROM files")
def s12_tar_import(spark: SparkSession, d: str) -> DataFrame:
    """Files are packed into archives of bounded size, and read back."""
    f = fx.files(spark, d).select(F.expr("substr(path, 2)").alias("path"), "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                size += len(row[1])
                if size >= ARCHIVE:
                    yield pa.RecordBatch.from_pydict({"data": [_tar_of(*zip(*held, strict=True))]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"data": [_tar_of(*zip(*held, strict=True))]})

    return import_tars(f.mapInArrow(pack, "data binary"), "data").select("path", "kind", "size", "digest")


MAGIC = b"ECF1"


def write_fragment(index: int, k: int, m: int, payload: bytes) -> bytes:
    head = MAGIC + bytes([index, k, m, 0]) + len(payload).to_bytes(4, "little")
    return head + payload + zlib.crc32(head + payload).to_bytes(4, "little")


def read_fragment(raw: bytes) -> tuple[int, int, int, bytes] | None:
    """index, k, m and payload; None if the magic, the length or the CRC is wrong."""
    if len(raw) < 16 or raw[:4] != MAGIC or int.from_bytes(raw[8:12], "little") != len(raw) - 16 or zlib.crc32(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
        return None
    return raw[4], raw[5], raw[6], raw[12:-4]


@query()
def s14_ec_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Stripes of four names as fragments; one of each is damaged: how many read well, and whether the stripe is whole again."""

    def code(g: np.ndarray, s: np.ndarray, lens: np.ndarray) -> list[tuple]:
        k, n = len(s), len(s) + 2
        full = coded(generator(k, 2), s)
        got, lost = np.zeros_like(full), []
        for j, i in enumerate(g.tolist()):
            missing = set(range(n))
            for c in range(n):
                raw = write_fragment(c, k, 2, full[c, j, : lens[j]].tobytes())
                raw = raw[:-1] + bytes([raw[-1] ^ 1]) if c == i % n else raw
                if f := read_fragment(raw):
                    got[f[0], j, : lens[j]] = np.frombuffer(f[3], np.uint8)
                    missing.discard(f[0])
            lost.append(missing)
        same = (restored(got, k, 2, lost)[:k] == s).all(axis=(0, 2))
        return [(i, n - len(x), bool(ok)) for i, x, ok in zip(g.tolist(), lost, same, strict=True)]

    rows = t(spark, d, "part").select(F.expr("p_partkey div 4").alias("g"), "p_partkey", "p_name")
    return by_stripe(rows, "p_partkey", "p_name", code, "g long, good long, restored boolean")


#: Manifest rows of a footer line, on average.
MARKED = 100_000


def marks(manifest: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, sha): for each bucket of paths the number of entries, and the SHA-256 of its entries in path order, chained row by row."""
    line = F.concat_ws("\t", "path", F.col("size").cast("string"), "digest")
    rows = manifest.select(F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket"), "path", line.alias("line"))
    chain = lambda s, _, line: (s[0] + 1, hashlib.sha256(f"{s[1]}{line}".encode()).hexdigest())
    return fold_in_order(rows, ["bucket"], ["path"], ["line"], (0, ""), chain, "n long, sha string")


def write_manifest(entries: DataFrame, path: str) -> None:
    """The manifest, then its footer; a stream without a footer is not whole."""
    entries.select("path", "size", "digest").write.parquet(f"{path}/manifest")
    written = entries.sparkSession.read.parquet(f"{path}/manifest")
    marks(written, -(-written.count() // MARKED) or 1).write.parquet(f"{path}/footer")


def send_snapshot(files: DataFrame, path: str) -> DataFrame:
    """Write contents, manifest and footer of a snapshot below `path`. The footer covers the manifest by buckets of paths, so that no task sees all."""
    files.select("path", "text").write.parquet(f"{path}/data")
    write_manifest(files, path)
    return files.sparkSession.read.parquet(f"{path}/manifest")


def receive_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Read a snapshot back and verify every path against its manifest. A manifest that differs from its footer is refused."""
    footer = spark.read.parquet(f"{path}/footer")
    total = footer.agg(F.sum("n")).first()
    manifest = spark.read.parquet(f"{path}/manifest")
    found = marks(manifest, -(-(total[0] or 0) // MARKED) or 1)
    if found.exceptAll(footer).unionByName(footer.exceptAll(found)).limit(1).count():
        raise ValueError("the snapshot's manifest does not match its footer")
    got = spark.read.parquet(f"{path}/data").select("path", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"))
    return verify_manifest(manifest, got)


@query("SELECT '/' || lang || '/' || source || '/' || doc_id AS path, 'ok' AS status FROM documents")
def s15_snapshot_send_receive(spark: SparkSession, d: str) -> DataFrame:
    """S15 and S16: a snapshot written, read again and verified."""
    path = scratch(spark, "snapshot")
    send_snapshot(fx.files(spark, d), path)
    return receive_snapshot(spark, path)


def put_objects(objects: DataFrame, id_col: str, text_col: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Cut objects into chunks and append the versions table (id -> ordered chunk hashes); the refcounts by hash."""
    c = chunks(objects, id_col, F.col(text_col), lambda b: fastcdc(b, 256, 1024, 4096))
    c.write.mode("append").parquet(f"{path}/chunks")
    c = objects.sparkSession.read.parquet(f"{path}/chunks")
    versions = c.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("chunks"), F.sum("length").alias("size"))
    return versions, c.groupBy("hash").agg(F.count("*").alias("refcount"), F.max("length").alias("length"))


@query("SELECT doc_id AS id, octet_length(encode(text))::BIGINT AS size FROM documents WHERE text <> ''")
def s24_chunked_put(spark: SparkSession, d: str) -> DataFrame:
    """S22 to S24: objects appended as chunk rows; sizes add up to what was put."""
    versions, _ = put_objects(t(spark, d, "documents"), "doc_id", "text", scratch(spark, "put"))
    return versions.select("id", "size")


def mint(root: bytes, caveats: list[str]) -> bytes:
    """A chain of keyed hashes, each keyed by the one before."""
    sig = root
    for c in caveats:
        sig = hmac.new(sig, c.encode(), hashlib.sha256).digest()
    return sig


def allowed(caveats: Column, path: Column, op: Column, now: int) -> Column:
    """Every caveat holds: `path:` prefix, `before:` time, `ops:` comma-joined set."""
    one = lambda c: F.when(c.startswith("path:"), F.startswith(path, F.substr(c, F.lit(6)))).when(c.startswith("before:"), F.lit(now) < F.substr(c, F.lit(8)).cast("long")).when(c.startswith("ops:"), F.array_contains(F.split(F.substr(c, F.lit(5)), ","), op)).otherwise(False)
    return F.forall(caveats, one)


@query("""SELECT doc_id, doc_id % 4 <> 3 AND starts_with('/' || lang || '/' || source, '/en/') AND doc_id % 7 <> 0 AND CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS ok FROM documents""")
def f6_capability_token(spark: SparkSession, d: str) -> DataFrame:
    """The chain is recomputed in Arrow batches (every fourth token was tampered with); caveats are column expressions."""
    i = F.col("doc_id")
    caveats = F.array(F.lit("path:/en/"), F.when(i % 7 == 0, "before:10").otherwise("before:1000"), F.lit("ops:read,list"))
    f = fx.files(spark, d).withColumn("caveats", caveats).withColumn("op", F.when(i % 3 == 0, "read").when(i % 3 == 1, "list").otherwise("write"))

    @F.pandas_udf("boolean")
    def chained(ids: pd.Series, cs: pd.Series) -> pd.Series:
        root = b"root"
        out = []
        for n, c in zip(ids, cs, strict=True):
            sig = mint(root, list(c))
            given = bytes([sig[0] ^ 1]) + sig[1:] if n % 4 == 3 else sig
            out.append(hmac.compare_digest(given, sig))
        return pd.Series(out)

    return f.select("doc_id", (chained("doc_id", "caveats") & allowed(F.col("caveats"), F.col("path"), F.col("op"), 100)).alias("ok"))
