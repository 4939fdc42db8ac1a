"""Exact dedup by a log-structured merge index over text digests.

Memtables (bounded batches of rows) are sorted by digest and flushed as runs: one entry for each digest, with the
smallest key and the number of rows. Only digests and keys are moved for that; texts are copied where a memtable holds
their digest twice. Compaction deals the entries by digest, merges the sorted runs and keeps the
smallest keys; texts stay where they are. Digests that several runs hold are hits. A filter of bounded size over the
hits decides, where the texts are read, which of them are sent on, and every hit is verified byte by byte: inside a
memtable against its neighbour, between runs against the first text of the digest. A hot text shrinks to one entry a
memtable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.bit_filter import bit_filter, may_hold
from cairn.llm.common import gives_back, maybe_broadcast, operator, stash, without

MEMTABLE_BYTES = 24 << 20
LAST = (1 << 63) - 1
RUN = "digest string, key long, n long, clash boolean"
INDEX = "digest string, key long, n long, runs long, clash boolean"

Batches = Iterator[pa.RecordBatch]


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def changed(c: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Where a sorted column differs from the row before."""
    if not len(c):
        return np.zeros(0, bool)
    return np.concatenate(([True], pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)))


def memtables(batches: Batches, limit: int) -> Iterator[pa.Table]:
    """Bounded batches of rows, as they came."""
    held, size = [], 0

    def full() -> pa.Table:
        nonlocal held, size
        t = pa.Table.from_batches(held)
        held, size = [], 0
        return t

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= limit:
            del b
            yield full()
    if held:
        yield full()


def by_digest(t: pa.Table) -> tuple[np.ndarray, pa.ChunkedArray, np.ndarray]:
    """A memtable's order by digest, the digests in that order, and by row whether its digest is there again."""
    order = pc.sort_indices(t["digest"]).to_numpy()
    digest = t["digest"].take(order)
    new = changed(digest)
    again = np.empty(len(t), bool)
    again[order] = ~(new & np.append(new[1:], True)[: len(t)])
    return order, digest, again


def copies_of(t: pa.Table, again: np.ndarray) -> pa.Table:
    """The rows (digest, text) of a memtable whose digest is there again, sorted."""
    few = t.select(["digest", "text"]).filter(pa.array(again))
    return few.take(pc.sort_indices(few, [("digest", "ascending"), ("text", "ascending")]))


def run_of(t: pa.Table) -> pa.Table:
    """The run of a memtable (digest, text, key): clash if the bytes of a digest's texts differ."""
    order, digest, again = by_digest(t)
    at = np.flatnonzero(changed(digest))
    key = np.minimum.reduceat(t["key"].to_numpy()[order], at) if len(at) else np.empty(0, np.int64)
    clash = np.zeros(len(at), bool)
    if again.any():
        few = copies_of(t, again)
        new = changed(few["digest"])
        other = changed(few["text"]) & ~new  # the byte verification
        clash[np.diff(np.append(at, len(t))) > 1] = np.maximum.reduceat(other, np.flatnonzero(new))
    return pa.table({"digest": digest.take(at), "key": key, "n": np.diff(np.append(at, len(t))), "clash": clash})


@gives_back
def compacted(batches: Batches) -> Batches:
    """Merged runs, sorted by digest -> one entry for each digest."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t.append_column("runs", pa.array(np.ones(len(t), np.int64)))
        t = pa.concat_tables([held, t.select(held.column_names)]).combine_chunks() if held else t
        at = np.flatnonzero(changed(t["digest"]))
        put = {"digest": t["digest"].take(at), "key": np.minimum.reduceat(t["key"].to_numpy(), at)}
        put |= {c: np.add.reduceat(t[c].to_numpy(), at) for c in ("n", "runs")}
        t = pa.table(put | {"clash": np.maximum.reduceat(t["clash"].to_numpy(), at)}).select(["digest", "key", "n", "runs", "clash"])
        held = t.slice(len(t) - 1)
        yield from t.slice(0, len(t) - 1).to_batches()
    if held:
        yield from held.to_batches()


def index_of(rows: DataFrame, memtable_bytes: int) -> DataFrame:
    """rows (digest, text, key) -> the compacted index."""

    @gives_back
    def flush(batches: Batches) -> Batches:
        for t in memtables(batches, memtable_bytes):
            run = run_of(t)
            del t
            yield from run.to_batches(max_chunksize=1 << 16)

    runs = stash(rows.mapInArrow(flush, RUN), "dedup-runs")
    return stash(runs.repartition("digest").sortWithinPartitions("digest").mapInArrow(compacted, INDEX), "dedup-index")


def hit_filter(hits: DataFrame) -> np.ndarray:
    """A filter over the hits' digests."""
    return bit_filter(hits.select(F.xxhash64("digest").alias("x")), hits.count())


def clashes(rows: DataFrame, index: DataFrame, memtable_bytes: int) -> DataFrame:
    """The digests that different texts share: found in a memtable, or by comparing the hits' texts between runs."""
    held = rows.sparkSession.sparkContext.broadcast(hit_filter(index.filter("runs > 1")))

    @gives_back
    def send(batches: Batches) -> Batches:
        words = held.value

        def passing() -> Batches:
            for b in batches:
                at = np.flatnonzero(may_hold(words, b.column(2).to_numpy()))
                if len(at):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["digest", "text"])

        for t in memtables(passing(), memtable_bytes):
            again = by_digest(t)[2]
            few = copies_of(t, again)
            few = few.filter(pa.array(changed(few["digest"]) | changed(few["text"])))
            rest = t.filter(pa.array(~again)).to_batches(max_chunksize=500)
            del t
            yield from few.to_batches(max_chunksize=500)
            del few
            yield from rest

    @gives_back
    def compare(batches: Batches) -> Batches:
        digest = text = None
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if d != digest:
                    digest, text = d, t
                elif t != text:
                    out.append(d)
            if out:
                yield pa.RecordBatch.from_pydict({"digest": sorted(set(out))})

    texts = rows.select("digest", "text", F.xxhash64("digest").alias("x")).mapInArrow(send, "digest string, text string")
    between = texts.repartition("digest").sortWithinPartitions("digest").mapInArrow(compare, "digest string")
    return stash(between.unionByName(index.filter("clash").select("digest")).distinct(), "dedup-clashes")


@operator
def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise: Callable[[Column], Column] = lambda c: c, digest: Callable[[Column], Column] = sha256_hex, memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of each group of equal (normalised) texts. Null text counts as empty.
    Rows that repeat both id and text share their decision, so both are kept (`drop_duplicates` then keeps one);
    rows without an id are kept only if no row of their group has one. If different texts share a digest,
    those digests are grouped by the text itself. The one id next to the end of the long range that stands for "no
    id" (the largest, or the smallest if the largest is kept) is read as none. An empty table gives an empty result;
    other columns are not read.
    """
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    ident = F.col(id_col).cast("long")
    # Bitwise not reverses the order of longs without overflow.
    key = F.coalesce(ident if keep == "smallest" else F.bitwise_not(ident), F.lit(LAST))
    rows = docs.select(digest(text).alias("digest"), text.alias("text"), key.alias("key"))
    index = index_of(rows, memtable_bytes)
    clash = clashes(rows, index, memtable_bytes)
    clashing = clash.count()
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest(text).alias("digest"))
    # Groups of copies are counted: few go to every task, so that a hot text is not dealt by its digest; many are joined by it.
    copies = index.filter("n > 1").select("digest", F.col("key").alias("least"), "n")
    copies = maybe_broadcast(copies, copies.count())
    sha = F.col("digest") if digest is sha256_hex else F.sha2(F.col("text"), 256)
    plain = (rows.join(clash, "digest", "left_anti") if clashing else rows).withColumn("sha", sha).select("id", "sha", "digest")
    out = plain.join(copies, "digest", "left").select("id", "sha", "least", "n")
    if clashing:
        mixed = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest(text).alias("digest"), key.alias("key")).join(clash, "digest", "left_semi")
        mixed = stash(mixed.select("id", F.sha2("text", 256).alias("sha"), "text", "key"), "dedup-mixed")
        split = mixed.groupBy("text").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
        out = out.unionByName(mixed.join(split, "text").select("id", "sha", "least", "n"))
    least = F.col("least")
    kept_id = F.when(least.isNull(), F.col("id")).when(least == LAST, F.lit(None)).otherwise(least if keep == "smallest" else F.bitwise_not(least))
    out = out.withColumn("keep_id", kept_id.cast("long"))
    return out.select(F.col("id").alias(id_col), "keep_id", F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", **kw) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows that repeat id and text one stays.

    An id that stands before several texts is kept for each text that it represents.
    """
    groups = exact_groups(docs, id_col=id_col, text_col=text_col, keep=keep, **kw).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("th"), "kept")
    text = kw.get("normalise", lambda c: c)(F.coalesce(F.col(text_col), F.lit("")))
    return without(docs, groups, groups.filter("not kept"), id_col, F.sha2(text, 256))
