"""Scalar functions: hashes, paths, calendar keys, address fields, block math, formats and reliability models."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.aggregates import LOG2_FRACTIONS, log2_q16
from cairn.operators.predicates import risk_band
from cairn.plans.registry import query
from cairn.sources import fixtures as fx
from cairn.sources.fixtures import t

GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK64 = (1 << 64) - 1


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The mixer, on whole arrays of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & MASK64
    return h


def fletcher32(data: bytes) -> int:
    """Sums of 16-bit little-endian words modulo 65535, both from 65535; closed form over the words."""
    w = np.frombuffer(data + b"\0" * (len(data) % 2), "<u2").astype(object if len(data) > 1 << 24 else np.uint64)
    n = len(w)
    s1 = (0xFFFF + int(w.sum())) % 0xFFFF if n else 0xFFFF
    s2 = (0xFFFF + n * 0xFFFF + int((w * np.arange(n, 0, -1, dtype=np.uint64)).sum() if n else 0)) % 0xFFFF if n else 0xFFFF
    return s2 << 16 | s1


def _bytes_udf(f: Callable[[bytes], object], kind: str) -> Callable:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else f(bytes(b)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


@query()
def x1_crc32(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query()
def x2_xxhash64(spark: SparkSession, d: str) -> DataFrame:
    """Seed 0, so not the built-in function, whose seed is 42."""
    h = _bytes_udf(lambda b: f"{xxhash.xxh64_intdigest(b, 0):016x}", "string")
    return t(spark, d, "documents").select("doc_id", h(F.col("text").cast("binary")).alias("xxh64"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def x3_sha256(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, sha256(lang || ':' || text) AS content_id, substr(sha256(lang || ':' || text), 1, 8) AS short_id FROM documents")
def x4_domain_content_id(spark: SparkSession, d: str) -> DataFrame:
    """Identity within a domain. The reference's digest function is in neither Spark nor this box; SHA-256 stands for it."""
    h = F.sha2(F.concat("lang", F.lit(":"), "text"), 256)
    return t(spark, d, "documents").select("doc_id", h.alias("content_id"), F.substring(h, 1, 8).alias("short_id"))


@query()
def x5_fletcher32(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", _bytes_udf(fletcher32, "long")(F.col("text").cast("binary")).alias("fletcher"))


def fnv1a64_all(data: pd.Series) -> np.ndarray:
    """FNV-1a of all values, one step for each byte place over those that are long enough."""
    raw = [bytes(b) for b in data]
    lens = np.array([len(b) for b in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    more = -lens[order]
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(int(lens.max(initial=0))):
            on = order[: np.searchsorted(more, -i, "left")]
            h[on] = (h[on] ^ flat[starts[on] + i]) * np.uint64(0x100000001B3)
    return h


@query()
def x6_fnv1a(spark: SparkSession, d: str) -> DataFrame:
    """Name hash and its bucket of 64."""

    @F.pandas_udf("hash string, bucket long")
    def hashed(names: pd.Series) -> pd.DataFrame:
        h = fnv1a64_all(names)
        return pd.DataFrame({"hash": [f"{x:016x}" for x in h.tolist()], "bucket": (h % np.uint64(64)).astype(np.int64)})

    return t(spark, d, "part").select("p_partkey", hashed(F.col("p_name").cast("binary")).alias("h")).select("p_partkey", "h.hash", "h.bucket")


@query()
def x7_splitmix_shard(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("long")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series((splitmix64(k.to_numpy().astype(np.uint64)) & np.uint64(15)).astype(np.int64))

    return t(spark, d, "part").select("p_partkey", shard("p_partkey").alias("shard"))


def path_parts(path: Column) -> Column:
    """Normal components: empty and `.` go, `..` takes the one before, at an absolute root it goes, else it stays."""
    absolute = path.startswith("/")

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        up = F.when((F.size(acc) > 0) & (last != ".."), F.slice(acc, 1, F.size(acc) - 1)).when(absolute, acc).otherwise(F.concat(acc, F.array(p)))
        return F.when(p.isin("", "."), acc).when(p == "..", up).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def normalize_path(path: Column) -> Column:
    joined = F.array_join(path_parts(path), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '/' || p_brand || '/b' WHEN 1 THEN '/x' WHEN 2 THEN '../' || p_brand WHEN 3 THEN '.' ELSE '/' || p_brand || '/c' END AS normal,
 CASE p_partkey % 5 WHEN 0 THEN 'b' WHEN 1 THEN 'x' WHEN 2 THEN p_brand WHEN 3 THEN NULL ELSE 'c' END AS basename, CASE p_partkey % 5 WHEN 0 THEN '/' || p_brand WHEN 1 THEN '/' WHEN 2 THEN '..' WHEN 3 THEN '' ELSE '/' || p_brand END AS dirname FROM part""")
def x10_paths(spark: SparkSession, d: str) -> DataFrame:
    k, b = F.col("p_partkey") % 5, F.col("p_brand")
    raw = F.when(k == 0, F.concat(F.lit("/"), b, F.lit("//./b"))).when(k == 1, F.lit("/a/../../x")).when(k == 2, F.concat(F.lit("a/../../"), b)).when(k == 3, F.lit("./a/..")).otherwise(F.concat(F.lit("/q/../"), b, F.lit("/c/")))
    parts = path_parts(raw)
    head = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return t(spark, d, "part").select("p_partkey", normalize_path(raw).alias("normal"), F.try_element_at(parts, F.lit(-1)).alias("basename"), F.when(raw.startswith("/"), F.concat(F.lit("/"), head)).otherwise(head).alias("dirname"))


@query(f"""WITH {fx.SNAPSHOTS}, x AS (SELECT id, make_date(1970, 1, 1) + (("at" // 86400)::INT) AS d FROM snapshots) SELECT id, year(d) AS y, (year(d) * 12 + month(d) - 1) AS m, isoyear(d) * 100 + week(d) AS w, day(d) AS dom FROM x""")
def x11_calendar_keys(spark: SparkSession, d: str) -> DataFrame:
    date = F.expr("date_from_unix_date(cast(floor(at / 86400) as int))")
    iso = F.expr("extract(yearofweek from date_from_unix_date(cast(floor(at / 86400) as int)))")
    long = lambda c: c.cast("long")
    return fx.snapshots(spark, d).select("id", long(F.year(date)).alias("y"), long(F.year(date) * 12 + F.month(date) - 1).alias("m"), long(iso * 100 + F.weekofyear(date)).alias("w"), long(F.day(date)).alias("dom"))


@query("SELECT p_partkey, p_size % 65536 AS volume, p_partkey % 16777216 AS region, p_partkey * 64 AS lba, ((p_size % 65536)::BIGINT << 24 | p_partkey) AS high FROM part")
def x12_address_pack(spark: SparkSession, d: str) -> DataFrame:
    """A 128-bit address as a struct of its fields, which compares as the packed number; the high word packed and unpacked."""
    p = F.col("p_partkey")
    a = F.struct((F.col("p_size") % 65536).cast("long").alias("volume"), (p % (1 << 24)).alias("region"), (p * 64).alias("lba"))
    return t(spark, d, "part").select("p_partkey", a.alias("a")).select("p_partkey", "a.volume", "a.region", "a.lba", F.shiftleft("a.volume", 24).bitwiseOR(F.col("a.region")).alias("high"))


def pack_extent(logical: int, physical: int, length: int, flags: int) -> bytes | None:
    if logical >= 1 << 48 or physical >= 1 << 48 or length >= 1 << 24 or flags & 0xE0:
        return None
    return logical.to_bytes(6, "little") + physical.to_bytes(6, "little") + length.to_bytes(3, "little") + bytes([flags])


def unpack_extent(raw: bytes) -> tuple[int, int, int, int] | None:
    if raw[15] & 0xE0:
        return None
    return int.from_bytes(raw[:6], "little"), int.from_bytes(raw[6:12], "little"), int.from_bytes(raw[12:15], "little"), raw[15]


def packed_extent(logical: Column, physical: Column, length: Column, flags: Column) -> Column:
    """The 16 bytes of `pack_extent` in hex, in little-endian order: 6, 6, 3 and 1."""
    byte = lambda x, i: F.lpad(F.lower(F.hex(F.shiftright(x, 8 * i).bitwiseAND(255))), 2, "0")
    return F.concat(*[byte(x, i) for x, n in ((logical, 6), (physical, 6), (length, 3), (flags, 1)) for i in range(n)])


@query()
def x13_extent_codec(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return fx.extents(spark, d).select("file", "logical", "physical", packed_extent(c("logical"), c("physical"), c("length"), F.lit(1).cast("long")).alias("packed"))


@query("SELECT p_partkey, ((p_partkey + 63) // 64) * 64 AS up, (p_partkey + 4095) // 4096 AS blocks, p_partkey > 0 AND (p_partkey & (p_partkey - 1)) = 0 AS power, bit_count(p_partkey)::BIGINT AS bits FROM part")
def x14_block_math(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return t(spark, d, "part").select(p, (F.expr("(p_partkey + 63) div 64") * 64).alias("up"), F.expr("(p_partkey + 4095) div 4096").alias("blocks"), ((p > 0) & (p.bitwiseAND(p - 1) == 0)).alias("power"), F.bit_count(p).cast("long").alias("bits"))


def human_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(["KiB", "MiB", "GiB", "TiB"], 1):
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.1f", F.bround(n / float(1024**i), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_hours(h: Column) -> Column:
    text = F.format_string("%.3f h", h)
    return F.when(h >= 8760, F.format_string("%.3f h (~%.1f years)", h, h / 8760)).when(h >= 1, text).when(h > 0, F.format_string("%.3f h (~%.1f minutes)", h, h * 60)).otherwise("∞")


@query("""WITH x AS (SELECT p_partkey, p_size::BIGINT * (CASE p_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 131072 ELSE 2147483648 END) AS n, p_size * 256.0::DOUBLE AS h FROM part)
SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576) WHEN n < 1099511627776 THEN printf('%.1f GiB', n / 1073741824) ELSE printf('%.1f TiB', n / 1099511627776) END AS size,
 CASE WHEN h >= 8760 THEN printf('%.3f h', h) || printf(' (~%.1f years)', h / 8760) ELSE printf('%.3f h', h) END AS hours FROM x""")
def x15_human_formats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    n = F.col("p_size").cast("long") * F.when(k == 0, 8).when(k == 1, 1 << 17).otherwise(1 << 31)
    return t(spark, d, "part").select("p_partkey", human_bytes(n).alias("size"), human_hours(F.col("p_size") * 256.0).alias("hours"))


@query("SELECT p_partkey, round(1 / (1 - u), 9) AS lfs, round(2 / (1 - u), 9) AS spec, round(1 + 1 / (1 - u), 9) AS journal FROM (SELECT p_partkey, p_size / 64.0::DOUBLE AS u FROM part)")
def x16_write_amp_models(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("p_size") / 64.0
    return t(spark, d, "part").select("p_partkey", F.round(1 / (1 - u), 9).alias("lfs"), F.round(2 / (1 - u), 9).alias("spec"), F.round(1 + 1 / (1 - u), 9).alias("journal"))


def mttdl(k: Column, m: Column, f: float, r: float) -> tuple[Column, Column]:
    """Hours to data loss of a stripe of k + m: by the Markov chain, and by the rare-event formula kept for comparison."""
    n = k + m
    choose = F.factorial(n - 1) / (F.factorial(m) * F.factorial(n - 1 - m))
    top = F.pow(F.lit(f), m + 1)
    return top / (n * F.factorial(m) * choose * F.pow(F.lit(r), m)), top / (n * choose * F.pow(F.lit(r), m) * (m + 1))


@query("""WITH x AS (SELECT p_partkey, (p_size % 8 + 2)::INT AS k, (p_size % 3 + 1)::INT AS m FROM part), c AS (SELECT *, k + m AS n, factorial(k + m - 1) / (factorial(m) * factorial(k - 1)) AS ch FROM x)
SELECT p_partkey, round(log10(pow(1e6, m + 1) / (n * factorial(m) * ch * pow(4.0, m))), 9)::DOUBLE AS ctmc_log, round(log10(pow(1e6, m + 1) / (n * ch * pow(4.0, m) * (m + 1))), 9)::DOUBLE AS spec_log, round(1e6::DOUBLE / 1000004, 9)::DOUBLE AS component FROM c""")
def x17_reliability(spark: SparkSession, d: str) -> DataFrame:
    k, m = (F.col("p_size") % 8 + 2).cast("int"), (F.col("p_size") % 3 + 1).cast("int")
    ctmc, spec = mttdl(k, m, 1e6, 4.0)
    return t(spark, d, "part").select("p_partkey", F.round(F.log10(ctmc), 9).alias("ctmc_log"), F.round(F.log10(spec), 9).alias("spec_log"), F.round(F.lit(1e6 / (1e6 + 4)), 9).alias("component"))


@query("SELECT p_partkey, round(pow((p_size + 1) / 100.0::DOUBLE, 0.2::DOUBLE), 9) AS hit, round(100 * pow((p_size + 1) / 100.0::DOUBLE, 5.0::DOUBLE), 6) AS cache, round(pow(p_partkey::DOUBLE, 2) / pow(2.0::DOUBLE, 33), 12) AS collisions, p_partkey * 1e9::DOUBLE / 2e8 <= 3.6e8 AS meets FROM part")
def x18_cache_models(spark: SparkSession, d: str) -> DataFrame:
    """Hit ratio of a cache at skew 0.8, the cache for a target ratio, prefix collisions at 32 bits, the scrub deadline."""
    x, p = (F.col("p_size") + 1) / 100.0, F.col("p_partkey").cast("double")
    return t(spark, d, "part").select("p_partkey", F.round(F.pow(x, F.lit(0.2)), 9).alias("hit"), F.round(100 * F.pow(x, F.lit(5.0)), 6).alias("cache"), F.round(p * p / 2.0**33, 12).alias("collisions"), (p * 1e9 / 2e8 <= 3.6e8).alias("meets"))


#: Fixed values of the failure model: shape x100, life in hours, weights x100, ln 2 in 16.16, hours a year and at most.
SHAPE, LIFE, WEIGHTS, LN2, YEAR, MOST = 130, 80_000, {"realloc": 40, "pending": 80, "crc": 10, "scrub": 60, "latency": 5}, 45_426, 8760, 876_000


def hazard(drives: DataFrame) -> DataFrame:
    """drives (hours, realloc, pending, crc, scrub, median, p99) with multiplier, baseline, annual (all x100), remaining hours, band.

    Integer steps with truncation, the exponential as four terms. Each step is a column, so that none is evaluated twice.
    """
    trunc = lambda x, n: F.when(x < 0, -F.floor(-x / n)).otherwise(F.floor(x / n)).cast("long")
    life = (16 << 16) + LOG2_FRACTIONS[(LIFE - 65536) * 16 // 65536]
    u, mult, annual = F.col("_u"), F.col("multiplier"), F.col("annual")
    d = drives.withColumn("_log", log2_q16(F.col("hours"))).withColumn("_u", trunc((SHAPE - 100) * (F.col("_log") - life) * LN2, 100 * 65536))
    power = F.least(F.greatest(65536 + u + trunc(u * u, 2 * 65536) + trunc(u * u * u, 6 * 65536 * 65536), F.lit(1)), F.lit(8 << 16))
    base = F.greatest(F.lit(1), F.least(F.lit(1_000_000), F.floor(SHAPE * YEAR * F.when(F.col("hours") > 0, power).otherwise(0) / (LIFE * 65536))))
    points = F.floor(F.greatest(F.floor(F.col("p99") * 10 / F.col("median")) - 20, F.lit(0)) / 2)
    weighed = 100 + sum(F.col(c) * w for c, w in WEIGHTS.items() if c != "latency") + F.when(F.col("median") > 0, points * WEIGHTS["latency"]).otherwise(0)
    d = d.withColumn("multiplier", weighed.cast("long")).withColumn("baseline", base.cast("long"))
    d = d.withColumn("annual", F.floor(F.col("baseline") * mult / 100))
    rest = F.when(annual == 0, MOST).otherwise(F.least(F.floor(F.lit(LN2 * YEAR * 100) / (annual * 65536)), F.lit(MOST)))
    return d.withColumn("remaining", rest.cast("long")).withColumn("band", risk_band(mult)).drop("_log", "_u")


@query("""WITH i AS (SELECT p_partkey AS device, p_partkey * 47 + 1 AS h, p_size % 7 AS re, p_size % 3 AS pe, p_size % 5 AS crc, p_size % 2 AS sc, 500 AS med, 400 + p_partkey % 2000 AS p99 FROM part),
f(t) AS (SELECT [0, 5732, 11134, 16241, 21087, 25706, 30102, 34303, 38328, 42186, 45890, 49458, 52896, 56211, 59417, 62516]),
l AS (SELECT i.*, (length(bin(h)) - 1) AS fh, t FROM i, f), q AS (SELECT *, fh * 65536 + t[least(15, (h - (1::BIGINT << fh)) * 16 // (1::BIGINT << fh)) + 1] - (16 * 65536 + t[(80000 - 65536) * 16 // 65536 + 1]) AS lr FROM l),
u AS (SELECT *, (trunc(30 * lr * 45426 / 6553600.0::DOUBLE))::BIGINT AS u FROM q),
p AS (SELECT *, greatest(1, least(524288, 65536 + u + (u * u) // 131072 + trunc(u * u * u / 25769803776.0::DOUBLE)::BIGINT)) AS pw FROM u),
b AS (SELECT device, greatest(1, least(1000000, 130 * 8760 * pw // (80000::BIGINT * 65536))) AS base, 100 + re * 40 + pe * 80 + crc * 10 + sc * 60 + greatest(p99 * 10 // med - 20, 0) // 2 * 5 AS mult FROM p)
SELECT device, mult::BIGINT AS multiplier, base::BIGINT AS baseline, (base * mult // 100)::BIGINT AS annual, CASE WHEN base * mult // 100 = 0 THEN 876000 ELSE least(876000, 39793176000 // (base * mult // 100 * 65536)) END::BIGINT AS remaining,
 CASE WHEN mult < 150 THEN 'healthy' WHEN mult < 400 THEN 'watch' WHEN mult < 1000 THEN 'degraded' ELSE 'failing' END AS band FROM b""")
def x19_weibull_hazard(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("p_size").cast("long")
    drives = t(spark, d, "part").select(p.alias("device"), (p * 47 + 1).alias("hours"), (s % 7).alias("realloc"), (s % 3).alias("pending"), (s % 5).alias("crc"), (s % 2).alias("scrub"), F.lit(500).cast("long").alias("median"), (400 + p % 2000).alias("p99"))
    return hazard(drives).select("device", "multiplier", "baseline", "annual", "remaining", "band")


@query()
def x20_compression(spark: SparkSession, d: str) -> DataFrame:
    """Sizes under deflate and zstd; a codec is kept only if its output is smaller."""

    @F.pandas_udf("codec string, size long")
    def best(s: pd.Series) -> pd.DataFrame:
        import zlib

        import zstandard

        z, out = zstandard.ZstdCompressor(level=3), []
        for b in s:
            b = bytes(b)
            sizes = {"zstd": len(z.compress(b)), "deflate": len(zlib.compress(b, 6))}
            codec = min(sizes, key=lambda c: (sizes[c], c))
            out.append((codec, sizes[codec]) if sizes[codec] < len(b) else ("raw", len(b)))
        return pd.DataFrame(out, columns=["codec", "size"])

    return t(spark, d, "documents").select("doc_id", F.octet_length("text").alias("raw"), best(F.col("text").cast("binary")).alias("b")).select("doc_id", "raw", "b.codec", "b.size")


@query("SELECT doc_id, text AS back FROM documents")
def x21_aes_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """AES-GCM as far as Spark has it: encrypt and decrypt every object."""
    key = F.lit("0123456789abcdef").cast("binary")
    return t(spark, d, "documents").select("doc_id", F.aes_decrypt(F.aes_encrypt(F.col("text").cast("binary"), key), key).cast("string").alias("back"))


def hkdf_sha256(master: bytes, info: bytes, size: int = 32, salt: bytes = b"") -> bytes:
    """Extract and expand (RFC 5869)."""
    key, out, block = hmac.digest(salt or bytes(32), master, "sha256"), b"", b""
    for i in range(-(-size // 32)):
        block = hmac.digest(key, block + info + bytes([i + 1]), "sha256")
        out += block
    return out[:size]


def pbkdf2_sha256(password: bytes, salt: bytes, iterations: int, size: int) -> bytes | None:
    """A key from a passphrase (RFC 8018); None for no iterations or sizes that are refused."""
    if not 0 < size <= 32 * 255 or iterations < 1:
        return None
    return hashlib.pbkdf2_hmac("sha256", password, salt, iterations, size)


#: What goes before a domain's and an extent's name in the derivation.
DOMAIN_INFO, EXTENT_INFO = b"cairn-domain:", b"cairn-extent:"


@query()
def x21_key_derivation(spark: SparkSession, d: str) -> DataFrame:
    """For every supplier the key of its passphrase, and the key of its domain below one master key."""
    master = bytes(range(32))

    @F.pandas_udf("wrapped string, domain string")
    def derived(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(pbkdf2_sha256(n.encode(), b"salt" + n.encode(), 50, 32).hex(), hkdf_sha256(master, DOMAIN_INFO + n.encode()).hex()) for n in names], columns=["wrapped", "domain"])

    return t(spark, d, "supplier").select("s_suppkey", derived("s_name").alias("k")).select("s_suppkey", "k.wrapped", "k.domain")


def convergent(text: Column, domain_key: Column, extent_key: Column) -> tuple[Column, Column]:
    """(sealed, opened): AES-GCM whose nonce follows from domain and content, so that equal contents of a domain seal equally; the content hash is authenticated."""
    content = F.unhex(F.sha2(text, 256))
    nonce = F.substring(F.unhex(F.sha2(F.concat(domain_key, content), 256)), 1, 12)
    sealed = F.aes_encrypt(text.cast("binary"), extent_key, F.lit("GCM"), F.lit("DEFAULT"), nonce, content)
    return sealed, F.aes_decrypt(sealed, extent_key, F.lit("GCM"), F.lit("DEFAULT"), content).cast("string")


@query("SELECT doc_id, true AS whole, count(*) OVER (PARTITION BY lang, text)::BIGINT AS alike FROM documents")
def x21_convergent_encryption(spark: SparkSession, d: str) -> DataFrame:
    """Every object sealed under its language's domain: whether it opens to what it was, and how many seal to the same bytes."""

    @F.pandas_udf("domain binary, extent binary")
    def keys(lang: pd.Series, digest: pd.Series) -> pd.DataFrame:
        domains = {x: hkdf_sha256(bytes(range(32)), DOMAIN_INFO + (x or "").encode()) for x in set(lang)}
        return pd.DataFrame([(domains[x], hkdf_sha256(domains[x], EXTENT_INFO + bytes.fromhex(h))) for x, h in zip(lang, digest, strict=True)], columns=["domain", "extent"])

    x = t(spark, d, "documents").withColumn("k", keys(F.coalesce("lang", F.lit("")), F.sha2("text", 256)))
    sealed, opened = convergent(F.col("text"), F.col("k.domain"), F.col("k.extent"))
    x = x.select("doc_id", (opened == F.col("text")).alias("whole"), F.sha2(sealed, 256).alias("sealed"))
    return x.select("doc_id", "whole", F.count(F.lit(1)).over(Window.partitionBy("sealed")).alias("alike"))


@query("SELECT p_partkey, lower(hex(p_name)) AS hex, substr(lower(hex(p_name)), 1, 12) AS short FROM part")
def x22_hex(spark: SparkSession, d: str) -> DataFrame:
    h = F.lower(F.hex("p_name"))
    return t(spark, d, "part").select("p_partkey", h.alias("hex"), F.substring(h, 1, 12).alias("short"))
