"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Sizes are summed by source and hash bucket. Each source's budget falls into one bucket of its histogram;
only that bucket is split further, by the next bits of the hash, until it holds one document. What lies
below the threshold is taken, so no sort of the corpus is needed and the selections of growing budgets nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import WORD, maybe_broadcast, operator, stash

HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    """The first 60 bits of the key's MD5: the same in every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, max_repeats: int = 3) -> DataFrame:
    """Targets by source: shares by weight, no source above `max_repeats` times its size.

    Weights are 1..cycle by rank of the source in code-point order, null last. The excess of capped sources is
    shared again until none is above its cap: sorted by cap/weight the capped ones are a prefix, so one pass
    over the sources (one row each) finds the level at which the others stand.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", ((F.row_number().over(rank) - 1) % cycle + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # Share of this source if all before it are capped; the first one that stays below its cap sets the level.
    share = (F.col("total") - F.col("capped")).cast("double") * F.col("weight") / F.col("weights")
    s = s.withColumn("open", share <= F.col("cap"))
    first = Window.partitionBy()
    pick = F.when(F.col("open"), F.struct(F.col("capped").alias("c"), F.struct("total", "weights").alias("tw")))
    s = s.withColumn("level", F.min(pick).over(first))
    level = F.col("level")
    even = (level["tw"]["total"] - level["c"]).cast("double") * F.col("weight") / level["tw"]["weights"]
    return s.select("source", "source_size", F.when(level.isNull() | (even >= F.col("cap")), F.col("cap").cast("double")).otherwise(even).alias("target"))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("h"))
    return stash(rows, "mix")


def _cuts(base: DataFrame, cycle: int, max_repeats: int) -> tuple[DataFrame, int]:
    """By source: what its documents are taken, the hash below which they are taken once more, and whether it is at its cap; the number of sources."""
    sizes = stash(base.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    n_sources = sizes.count()
    target, own = F.col("target"), F.col("source_size")
    reps = F.when(own > 0, F.floor(target / own)).otherwise(0).cast("long")
    state = source_targets(sizes, cycle, max_repeats).withColumn("reps", reps)
    zero = F.lit(0).cast("long")
    state = state.select("source", "source_size", "target", "reps", (target - F.col("reps") * own).alias("budget"), zero.alias("lo"), F.lit(1 << HASH_BITS).alias("hi"), zero.alias("below"), zero.alias("here"), F.lit(2).cast("long").alias("n"))
    state = stash(state, "mix-state")
    shift = HASH_BITS
    while shift > 0 and state.agg(F.max("n")).first()[0] not in (None, 0, 1):
        shift -= LEVEL_BITS
        state = _refine(base, state, n_sources, shift)
    # The boundary document goes in if that is nearer to the budget than leaving it out.
    nearer = (F.col("here") > 0) & (F.col("below") + F.col("here") - F.col("budget") < F.col("budget") - F.col("below"))
    # At the cap nothing is taken once more, not even what has no words.
    cut = F.when(F.col("reps") >= max_repeats, 0).when(nearer, F.col("hi")).otherwise(F.col("lo"))
    return state.select(F.col("source").alias("s"), "source_size", "target", "reps", cut.alias("cut")), n_sources


def _repeats() -> Column:
    return F.col("reps") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)


@operator
def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cycle: int = 3, max_repeats: int = 3) -> DataFrame:
    """One row per input row: id, size, source_size, target, repeats, taken.

    A document is taken floor(target / source_size) times, and once more if its hash lies below its source's
    threshold, chosen so that the words taken are within half a document of the target.
    Null or empty text: size 0. Null source: a source of its own, last in order. Rows with the same id share a
    hash and so a decision. An empty table gives an empty result; other columns are not read.
    """
    base = _sized(docs, id_col, source_col, text_col)
    cuts, n_sources = _cuts(base, cycle, max_repeats)
    out = base.join(maybe_broadcast(cuts, n_sources), F.col("source").eqNullSafe(F.col("s"))).withColumn("repeats", _repeats())
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "repeats")


@operator
def _thresholds(docs: DataFrame, id_col: str, source_col: str, text_col: str, cycle: int, max_repeats: int) -> DataFrame:
    return _cuts(_sized(docs, id_col, source_col, text_col), cycle, max_repeats)[0]


def mixed(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cycle: int = 3, max_repeats: int = 3) -> DataFrame:
    """Each row of docs as often as `mix_sources` takes it, with all its columns. Only the table of sources is joined; texts do not move."""
    cuts = _thresholds(docs, id_col, source_col, text_col, cycle, max_repeats).select(*[F.col(c).alias(f"_cairn_{c}") for c in ("s", "reps", "cut")])
    rows = docs.join(maybe_broadcast(cuts, cuts.count()), F.col(source_col).eqNullSafe(F.col("_cairn_s")))
    again = F.col("_cairn_reps") + F.when(hash60(F.col(id_col)) < F.col("_cairn_cut"), 1).otherwise(0)
    return rows.withColumn("_cairn_n", again).filter("_cairn_n > 0").withColumn("_cairn_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_cairn_n")))).select(docs.columns)


def _refine(base: DataFrame, state: DataFrame, n_sources: int, shift: int) -> DataFrame:
    """Split each source's boundary range [lo, hi) by the next bits and find the bucket in which its budget ends."""
    edge = maybe_broadcast(state.select(F.col("source").alias("s"), "lo", "hi", "budget", "below").filter("n > 1"), n_sources)
    inside = base.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") >= F.col("lo")) & (F.col("h") < F.col("hi")))
    hist = inside.groupBy("s", "hi", "budget", "below", F.shiftrightunsigned("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
    hist = hist.withColumn("upto", F.col("below") + upto)
    found = hist.groupBy(F.col("s").alias("hs")).agg(F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", "words", "docs", "upto"))).alias("e"), F.max("upto").alias("all"))
    new = state.join(maybe_broadcast(found, n_sources), F.col("source").eqNullSafe(F.col("hs")), "left")
    e, settled = F.col("e"), F.col("all").isNull()

    def pick(kept: str, inside_: Column, past: Column) -> Column:
        return F.when(settled, F.col(kept)).when(e.isNotNull(), inside_).otherwise(past).alias(kept)

    zero = F.lit(0).cast("long")
    return stash(
        new.select(
            "source", "source_size", "target", "reps", "budget",
            pick("lo", F.shiftleft(e["bucket"], shift), F.col("hi")),
            pick("hi", F.shiftleft(e["bucket"] + 1, shift), F.col("hi")),
            pick("below", e["upto"] - e["words"], F.col("all")),
            pick("here", e["words"], zero),
            pick("n", e["docs"], zero),
        ),
        "mix-state",
    )
