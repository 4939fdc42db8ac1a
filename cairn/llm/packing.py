"""Best-fit packing under conflicts.

Rows are dealt by hash to shards of bounded expected size, packed independently, largest first. Open bins stand
in residual order; each carries the set of its sources and of its duplicate clusters as bitmaps. For a
document the successor search starts at the smallest residual that holds it and goes on upward until the tightest
bin without a conflict is found; only if there is none a bin is opened. Per source and cluster a bitmap over the
residuals tells where a bin without it stands, so that full rows of incompatible bins are skipped at once.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import operator, stash


#: Equal rows that are numbered by one task.
CHUNK = 1 << 20


class Bins:
    """Open bins of one shard by residual, and within a residual by what they carry."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self.bits: dict = {}  # source or cluster -> its bit
        self.carried: list[int] = []  # by bin: bitmap of its sources and clusters
        self.residual: list[int] = []
        self.at: dict[int, dict[int, list[int]]] = defaultdict(dict)  # residual -> bitmap -> bins, a stack
        self.total = [0] * (capacity + 1)
        self.having: dict[int, list[int]] = {}  # bit -> bins by residual that carry it
        self.free: dict[int, int] = {}  # bit -> bitmap of residuals with a bin that lacks it
        self.any = 0

    def bit(self, key: tuple) -> int:
        if key not in self.bits:
            self.bits[key] = len(self.bits)
        return self.bits[key]

    def track(self, bit: int) -> None:
        """From now on keep the residual bitmap of this bit; it stands in no open bin, or its bins are counted here."""
        having = [0] * (self.capacity + 1)
        for r, groups in self.at.items():
            for carried, bins in groups.items():
                if carried >> bit & 1:
                    having[r] += len(bins)
        self.having[bit] = having
        self.free[bit] = sum(1 << r for r in range(self.capacity + 1) if self.total[r] > having[r])

    def _move(self, bin_: int, sign: int) -> None:
        r, carried = self.residual[bin_], self.carried[bin_]
        group = self.at[r]
        if sign > 0:
            group.setdefault(carried, []).append(bin_)
        else:
            group[carried].remove(bin_) if group[carried][-1] != bin_ else group[carried].pop()
            if not group[carried]:
                del group[carried]
        self.total[r] += sign
        mask = 1 << r
        self.any = self.any | mask if self.total[r] else self.any & ~mask
        for bit, having in self.having.items():
            if carried >> bit & 1:
                having[r] += sign
            self.free[bit] = self.free[bit] | mask if self.total[r] > having[r] else self.free[bit] & ~mask

    def find(self, size: int, bits: list[int]) -> int | None:
        """The tightest open bin that holds `size` and carries none of `bits`."""
        where, conflict = self.any, 0
        for b in bits:
            conflict |= 1 << b
            if b in self.free:
                where &= self.free[b]
        where >>= size
        r = size
        while where:
            step = (where & -where).bit_length() - 1
            r, where = r + step, where >> step
            for carried, bins in self.at[r].items():
                if not carried & conflict:
                    return bins[-1]
            where >>= 1
            r += 1
        return None

    def put(self, size: int, bits: list[int]) -> tuple[int, int]:
        """Place a document; its bin and its offset in it."""
        bin_ = self.find(size, bits)
        if bin_ is None:
            bin_, self.n = self.n, self.n + 1
            self.residual.append(self.capacity)
            self.carried.append(0)
        else:
            self._move(bin_, -1)
        offset = self.capacity - self.residual[bin_]
        self.residual[bin_] -= size
        for b in bits:
            self.carried[bin_] |= 1 << b
        self._move(bin_, 1)
        return bin_, offset


def pack(rows: list[tuple], capacity: int, track_after: int = 64) -> list[tuple[int, int]]:
    """rows (size, source, cluster), in the order of placing -> (bin, offset). Null sources and clusters never conflict."""
    bins, seen = Bins(capacity), defaultdict(int)
    out = []
    for size, source, cluster in rows:
        bits = [bins.bit(k) for k in (("s", source), ("c", cluster)) if k[1] is not None]
        for b in bits:
            seen[b] += 1
            if seen[b] == track_after:
                bins.track(b)
        out.append(bins.put(size, bits))
    return out


@operator
def pack_documents(docs: DataFrame, *, size: Column, id_col: str = "doc_id", source: Column | None = None, cluster: Column | None = None, capacity: int = 2048, per_shard: int = 2048) -> DataFrame:
    """id, piece, size, shard, bin, bin_id, start: every input row, none dropped.

    No bin holds two pieces of one source or of one cluster (null: no conflict) or more than `capacity`. A document above the
    capacity is cut: full pieces each fill a bin of their own, the rest is packed as piece number `pieces - 1`.
    Documents of size 0 are placed too. Null sizes count as 0. Rows that repeat are placed each for itself. Ties in size go by id,
    source and cluster, so reruns agree. The number of shards grows with the rows, so a shard's memory does not.
    """
    rows = stash(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("words"),
            (F.lit(None) if source is None else source).cast("string").alias("source"),
            (F.lit(None) if cluster is None else cluster).cast("string").alias("cluster"),
        ),
        "packing",
    )
    n = rows.count()
    shards = max(1, -(-n // per_shard))
    if shards > 1:
        # Rows without an id, or that repeat, are numbered, so that they spread over the shards like any others.
        counted = rows.groupBy("id", "words", "source", "cluster").agg(F.count(F.lit(1)).alias("n"))
        some = counted.filter(F.col("n") <= CHUNK).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        many = counted.filter(F.col("n") > CHUNK).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
        many = many.repartition("at").withColumn("k", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + CHUNK, F.col("n")) - 1))).drop("at")
        rows = some.unionByName(many).withColumn("shard", F.pmod(F.xxhash64("id", "words", "source", "cluster", "k"), F.lit(shards)))
        rows = stash(rows.select("id", "words", "source", "cluster", "shard"), "packing-shards")
    else:
        rows = rows.withColumn("shard", F.lit(0).cast("long"))
    whole = F.when(F.col("words") > 0, F.floor((F.col("words") - 1) / capacity)).otherwise(0)
    rows = rows.withColumn("full", whole.cast("long")).withColumn("size", F.col("words") - F.col("full") * capacity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "source", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="last")
        source, cluster = (pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("source", "cluster"))
        placed = pack(list(zip(pdf["size"].tolist(), source, cluster, strict=True)), capacity)
        pdf["bin"], pdf["start"] = [b for b, _ in placed], [s for _, s in placed]
        return pdf[["id", "full", "size", "shard", "bin", "start"]]

    last = rows.groupBy("shard").applyInPandas(run, "id long, full long, size long, shard long, bin long, start long")
    last = last.select("id", F.col("full").alias("piece"), "size", "shard", F.concat_ws("-", "shard", "bin").alias("bin_id"), "start")
    # A full piece is alone in its bin, so it needs no search.
    full = rows.filter("full > 0").select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"), F.lit(capacity).cast("long").alias("size"), "shard")
    full = full.select("id", "piece", "size", "shard", F.concat_ws("-", F.lit("full"), "id", "piece").alias("bin_id"), F.lit(0).cast("long").alias("start"))
    return last.unionByName(full).withColumnRenamed("id", id_col)
