"""Exact links between texts with similar sets of word shingles: count filter, prefix filter, leader rounds.

Two sets with a Jaccard similarity of at least s lack at most n - ceil(s n) shingles of one another; p is one more. In any
common order they therefore share many of the first 2 p of each. In the order of the hashes a first pass finds, over
all documents, which of these shingles several sets hold, and leaves out every set of which too few are shared: it has no
similar one. The others' whole sets are ordered by frequency, rarest first; a similar pair shares one among the first p of
each, and where it shares the first one, enough of both must still follow (positional filter). What is left are lists of
texts that may be similar. As only components are asked for, a list need not be compared pair by pair: in a leader round
each list compares a few members with those that are not under their roots yet, and what links is merged. Once rounds
leave most of the open pairs as they are (members of one list, under different roots), the rest is settled by what each
set has other than a leader's: near copies of one text share most of their shingles, and few of these differences, so a
second prefix filter, over the differences, meets few pairs (`all_open`). Parity bits rule out most that it does: each set
keeps, for SKETCH * 64 classes of shingles, whether it holds an odd number; where two sets differ in such a bit they differ
in a shingle at least, so this never rules out a similar pair. Every comparison is made on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.bit_filter import FILTER_BITS, MAX_FILTER_BITS, bit_filter, may_hold
from cairn.llm.common import gives_back, maybe_broadcast, stash
from cairn.llm.components import connected_components
from cairn.llm.shingles import Words, simhashes, slices
from cairn.llm.simhash import identified, relabelled

#: How many prefixes the first pass looks at.
WIDE = 2
#: Leaders of a list in a round, and the share of pairs that may be left open for another round to be worth it.
LEADERS, WORTH = 4, 0.5
#: 64-bit words of a set's parity bits.
SKETCH = 16
#: Classes of a group's members, by how far they are from their leader.
CLASSES = 4


def describe(docs: DataFrame, id_col: str, text_col: str, width: int, set_width: int, similarity: tuple[int, int]) -> DataFrame:
    """id, th, fp (SimHash), sk (key of the shingle set, null without words), n (its size), wide (its least hashes, twice the prefix)."""
    num, den = similarity

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, sk, size, wide = [], [], [], []
            for part in slices(b.column(2).to_pylist()):
                words = Words(part)
                fp += simhashes(words, width).tolist()
                for h in words.sets(set_width):
                    n = len(h)
                    sk.append(int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42)).view(np.int64)) if n else None)
                    size.append(n)
                    wide.append(h[: WIDE * (n + 1 - -(-num * n // den))])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fp, pa.int64()), pa.array(sk, pa.int64()), pa.array(size, pa.int64()), pa.array(wide, pa.list_(pa.int64()))], names=["id", "th", "fp", "sk", "n", "wide"]
            )

    return stash(identified(docs, id_col, text_col).mapInArrow(run, "id long, th long, fp long, sk long, n long, wide array<long>"), "simhash")


def equal_sets(base: DataFrame) -> DataFrame:
    """(a, b): fingerprints of texts with the same shingle set, in a star."""
    sets = base.filter("sk is not null").groupBy("sk").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a <> z").select("sk", "a")
    return base.select("sk", F.col("fp").alias("b")).join(sets, "sk").filter("a <> b").select("a", "b").distinct()


def prefix_length(n: Column, num: int, den: int) -> Column:
    """n - ceil(n num / den) + 1: more of a set than a similar one can lack."""
    return n + 1 - F.floor((n * num + den - 1) / den)


def candidates(base: DataFrame, num: int, den: int) -> DataFrame:
    """(sk, n): the sets that may have a similar one, by what others share of their least hashes.

    Of the first WIDE p hashes of a set, a similar one with prefix q has more than (WIDE - 1) min(p, q) among its own, and
    it is not shorter than num / den of the set. A set of which others share less has no similar one.
    """
    sets = base.filter("sk is not null")
    post = sets.select(F.explode("wide").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    shared = stash(post.filter("n > 1").select("h"), "sets-shared")  # repeated sets share with themselves, which only lets more through
    many = shared.count()
    n = F.col("n")
    shortest = prefix_length(F.floor((n * num + den - 1) / den), num, den)
    need = F.least((WIDE - 1) * F.least(prefix_length(n, num, den), shortest) + 1, F.size("wide"))
    if many * FILTER_BITS <= MAX_FILTER_BITS:
        held = base.sparkSession.sparkContext.broadcast(bit_filter(shared.select(F.xxhash64("h").alias("x")), many))

        @gives_back
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = held.value
            for b in batches:
                lists_ = b.column(2)
                ok = np.concatenate(([0], np.cumsum(may_hold(words, lists_.flatten().to_numpy()))))
                at = lists_.offsets.to_numpy() - lists_.offsets[0].as_py()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(ok[at[1:]] - ok[at[:-1]])], names=["sk", "n", "need", "c"])

        # The filter is asked for xxhash64 of the hashes, made here.
        rows = sets.select("sk", "n", F.transform("wide", lambda h: F.xxhash64(h)).alias("x"), need.cast("long").alias("need"))
        counted = rows.mapInArrow(probe, "sk long, n long, need long, c long")
    else:
        rows = sets.select("sk", "n", need.alias("need"), F.explode("wide").alias("h")).distinct()
        counted = rows.join(shared, "h").groupBy("sk", "n", "need").agg(F.count(F.lit(1)).alias("c"))
    return stash(counted.filter("c >= need").select("sk", "n").distinct(), "sets-candidates")


def lists(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(h, sk, n, p): the shingles in the prefixes of several sets, with their place p in the order of frequency among the candidates."""
    post = sets.select("sk", "n", F.explode("s").alias("h"))
    held = post.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    rare = post.join(held, "h").groupBy("sk", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared"))  # a set's own shingles
    alone = F.col("n") - F.size("shared")  # these come first in the order
    rare = rare.withColumn("k", prefix_length(F.col("n"), num, den) - alone).filter("k > 0")
    rows = rare.select("sk", "n", alone.alias("alone"), F.posexplode(F.slice("shared", 1, F.col("k").cast("int"))).alias("i", "x"))
    rows = stash(rows.select("x.h", "sk", "n", (F.col("alone") + F.col("i")).alias("p")), "sets-lists")
    early = (F.col("n") - F.col("p")) * (num + den) >= 2 * num * F.col("n")  # where the shorter of two has its first shared one
    met = rows.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.bool_or(early).alias("early")).filter("m > 1 and early").select("h")
    return rows.join(met, "h", "left_semi")


def merge(docs: DataFrame, base: DataFrame, nodes: DataFrame, id_col: str, text_col: str, set_width: int, similarity: tuple[int, int]) -> DataFrame:
    """nodes (fp, root) with the components joined whose texts are similar."""
    num, den = similarity
    sets = whole_sets(docs, base, candidates(base, num, den), id_col, text_col, set_width)
    of = base.filter("sk is not null").groupBy("sk").agg(F.min("fp").alias("fp")).join(nodes, "fp").select("sk", "root")
    open_ = stash(lists(sets, num, den).join(of, "sk").select("h", "sk", "p", "n", "root"), "sets-open")
    edges, before, number = None, float("inf"), 0
    while True:
        mixed = open_.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("h")
        open_ = stash(open_.join(mixed, "h", "left_semi"), "sets-open")
        counts = open_.groupBy("h", "root").agg(F.count(F.lit(1)).cast("double").alias("c"))
        counts = counts.groupBy("h").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("q"))
        rows, pairs = counts.agg(F.sum("c"), F.sum((F.col("c") * F.col("c") - F.col("q")) / 2)).first()
        if not rows:
            break
        last = pairs <= 2 * rows or pairs >= before * WORTH
        met = stash(all_open(open_, sets, num, den) if last else led(open_, number, num, den), "sets-met")
        found = similar(met, sets, num, den)
        edges = found if edges is None else edges.unionByName(found)
        if last:
            break
        open_, before, number = relabelled(open_, toward_leaders(found)), pairs, number + 1
    return nodes if edges is None else relabelled(nodes, connected_components(edges))


def toward_leaders(found: DataFrame) -> DataFrame:
    """(node, root): components that go under a leader's to which they were found similar.

    One step of merging: what is under one root is connected, though not all that is connected is under one root yet.
    Leaders themselves only go to smaller ones, so none changes places with another.
    """
    to = found.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    leaders = found.select(F.col("b").alias("_leader")).distinct()
    return to.join(leaders, F.col("node") == F.col("_leader"), "left").filter("_leader is null or root < node").select("node", "root")


def whole_sets(docs: DataFrame, base: DataFrame, asked: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(sk, n, s): the whole shingle sets asked for, made again from the documents; one row a set."""
    n = asked.count()
    rows = base.select("id", "th", "sk").join(maybe_broadcast(asked, n), "sk").groupBy("sk").agg(F.min(F.struct("id", "th")).alias("of"))
    rows = stash(rows.select("sk", F.col("of.id").alias("_id"), F.col("of.th").alias("_th")), "sets-asked")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [x for part in slices(b.column(1).to_pylist()) for x in Words(part).sets(width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in s], pa.int64()), pa.array(s, pa.list_(pa.int64()))], names=["sk", "n", "s"])

    texts = identified(docs, id_col, text_col).join(maybe_broadcast(rows, n), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    sets = stash(texts.select("sk", "text").mapInArrow(run, "sk long, n long, s array<long>"), "sets-whole")
    if sets.count() > n:  # rows that repeat both id and text
        sets = stash(sets.dropDuplicates(["sk"]), "sets-whole")
    return sets


def _other(rows: DataFrame, suffix: str) -> DataFrame:
    return rows.select("h", *[F.col(c).alias(f"{c}{suffix}") for c in rows.columns if c != "h"])


def _may_be_similar(num: int, den: int) -> Column:
    """Length and positional filter: were this the first shingle that both share, enough must follow in both."""
    long_enough = F.least("n1", "n2") * den >= F.greatest("n1", "n2") * num
    return long_enough & (F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) * (num + den) >= (F.col("n1") + F.col("n2")) * num)


def led(open_: DataFrame, number: int, num: int, den: int) -> DataFrame:
    """Each list's leaders against the members under other roots; other leaders each round."""
    order = [F.xxhash64("sk", F.lit(number * LEADERS + i)) for i in range(LEADERS)]
    first = open_.groupBy("h").agg(*[F.min(F.struct(x.alias("x"), "sk", "p", "n", "root")).alias(f"l{i}") for i, x in enumerate(order)])
    leader = first.select("h", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"l{i}.{c}").alias(f"{c}2") for c in ("sk", "p", "n", "root")]) for i in range(LEADERS)]))).alias("l")).select("h", "l.*")
    met = _other(open_, "1").join(leader, "h").filter((F.col("root1") != F.col("root2")) & _may_be_similar(num, den))
    return met.select("sk1", "root1", "sk2", "root2").distinct()


def parity_bits(s: Column) -> Column:
    """SKETCH words of bits: bit i is set if the set holds an odd number of shingles of class i."""

    def word(i: int) -> Column:
        of = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(SKETCH - 1)) == i
        return F.aggregate(s, F.lit(0).cast("long"), lambda x, h: F.when(of(h), x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))).otherwise(x))

    return F.array(*[word(i) for i in range(SKETCH)])


def _few_bits_differ(num: int, den: int) -> Column:
    """Sets differ in as many shingles as bits, or more; with more than this leaves, they are not similar."""
    differ = sum((F.bit_count(F.col("bits1")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(SKETCH)), F.lit(0))
    return (F.col("n1") + F.col("n2") - differ) * (num + den) >= (F.col("n1") + F.col("n2")) * (2 * num)


def led_groups(open_: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, sk, root): the members of each list under one of them, twice by length classes of which any two similar sets share one.

    The leader is the least in one order for all lists, so the lists of one group of texts mostly have the same.
    """
    at = F.log(F.col("n").cast("double")) / ((3 * math.log(den / num)) or 1.0)
    rows = open_.select("h", "sk", "root", F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), F.floor(at + i / 2).alias("class")) for i in (0, 1)])).alias("c")).select("h", "sk", "root", "c.*")
    key = ["h", "grid", "class"]
    first = rows.groupBy(*key).agg(F.min(F.struct(F.xxhash64("sk"), "sk"))["sk"].alias("leader"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    return rows.join(first.select(*key, "leader"), key).select("leader", "sk", "root").distinct()


def deltas(open_: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, sk, root, n, m, w, d): where each member's set differs from its leader's: d, of size m; w is (num + den) m - (den - num) n."""
    group = stash(led_groups(open_, num, den), "sets-groups")
    asked = stash(group.select("sk").distinct(), "sets-asked")
    some = sets.join(maybe_broadcast(asked, asked.count()), "sk", "left_semi")
    own = group.join(some.select("sk", "n", "s"), "sk").join(some.select(F.col("sk").alias("leader"), F.col("s").alias("l")), "leader")
    rows = own.select("leader", "sk", "root", "n", F.concat(F.array_except("s", "l"), F.array_except("l", "s")).alias("d"))
    m = F.size("d").cast("long")
    return stash(rows.select("leader", "sk", "root", "n", m.alias("m"), (m * (num + den) - F.col("n") * (den - num)).alias("w"), "d"), "sets-deltas")


def delta_prefixes(rows: DataFrame, stats: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, x, sk, root, n, w, rest, own, other, minor): by class of the partner's w, the first of each delta that a similar one must meet; rest follow, with it."""
    n, m, w = F.col("n"), F.col("m"), F.col("w")
    post = rows.join(stats.select("leader", "main"), "leader").select("leader", "sk", (F.col("root") != F.col("main")).alias("minor"), F.explode("d").alias("x"))
    held = post.groupBy("leader", "x").agg(F.count(F.lit(1)).alias("df"), F.bool_or("minor").alias("minor")).filter("df > 1 and minor").select("leader", "x", "df")
    rare = post.join(held, ["leader", "x"]).groupBy("leader", "sk").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("shared"))  # a member's own differences
    all_ = rows.drop("d").join(rare, ["leader", "sk"]).join(stats, "leader")
    all_ = all_.select("leader", "sk", "root", "n", "m", "w", "shared", (F.col("root") != F.col("main")).alias("minor"), (F.size(F.filter("cuts", lambda c: c <= w)) - 1).alias("own"), "cuts", F.posexplode("cuts").alias("other", "lo"))
    least = F.greatest("lo", 1 - w, w - 2 * (den - num) * F.floor(n * den / num).cast("long"))  # the least w that a partner of this class can have
    all_ = all_.withColumn("next", F.get("cuts", F.col("other") + 1)).filter(F.col("next").isNull() | (least < F.col("next")))
    need = F.greatest(F.lit(1), F.ceil((w + least) / (2 * (num + den)))).cast("long")
    alone = m - F.size("shared")  # these come first in the order
    all_ = all_.withColumn("alone", alone).withColumn("k", m - need + 1 - alone).filter("k > 0")
    out = all_.select("leader", "sk", "root", "n", "m", "w", "own", "other", "minor", "alone", F.posexplode(F.slice("shared", 1, F.col("k").cast("int"))).alias("i", "y"))
    return stash(out.select("leader", "y.x", "sk", "root", "n", "w", (m - F.col("alone") - F.col("i")).alias("rest"), "own", "other", "minor"), "sets-prefixes")


def all_open(open_: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of lists' members under different roots that may be similar; they link all such pairs that are.

    With a and b what two sets have other than their leader's, the sets are similar if, and only if, w of both is at most
    2 (num + den) |a & b|. If the w are not above zero together, both are similar to the member of least w, which stands
    for the pair. Else a and b meet: in the order of frequency in the group, among the first of each, the fewer the larger
    the two w are. One of the two is not under the group's most frequent root. Parity bits rule out most of what is left.
    """
    rows = deltas(open_, sets, num, den)
    main = rows.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("leader").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    cuts = F.concat(F.array(F.min("w")), F.percentile_approx("w", [i / CLASSES for i in range(1, CLASSES)]))
    stats = rows.groupBy("leader").agg(F.min(F.struct("w", "sk", "root")).alias("first"), F.array_sort(F.array_distinct(cuts)).alias("cuts"))
    stats = stash(stats.join(main, "leader"), "sets-leaders")
    near = rows.join(stats, "leader").filter((F.col("w") + F.col("first.w") <= 0) & (F.col("root") != F.col("first.root")))
    near = near.select(F.col("sk").alias("sk1"), F.col("root").alias("root1"), F.col("first.sk").alias("sk2"), F.col("first.root").alias("root2"))
    rows = delta_prefixes(rows, stats.select("leader", "main", "cuts"), num, den)
    member = ["sk", "root", "n", "w", "rest"]
    one, other = ([F.col(c).alias(f"{c}{i}") for c in member] for i in (1, 2))
    one = rows.filter("minor").select("leader", "x", F.col("own").alias("i"), F.col("other").alias("j"), *one)
    other = rows.select("leader", "x", F.col("other").alias("i"), F.col("own").alias("j"), *other)
    sum_ = F.col("w1") + F.col("w2")
    long_enough = F.least("n1", "n2") * den >= F.greatest("n1", "n2") * num
    met = one.join(other, ["leader", "x", "i", "j"]).filter((F.col("root1") != F.col("root2")) & (sum_ > 0) & long_enough & (F.least("rest1", "rest2") * (2 * (num + den)) >= sum_))
    met = stash(met.select("sk1", "root1", "sk2", "root2", "n1", "n2").distinct(), "sets-may-meet")
    asked = stash(met.select(F.col("sk1").alias("sk")).unionByName(met.select(F.col("sk2").alias("sk"))).distinct(), "sets-asked")
    many = asked.count()
    bits = stash(sets.join(maybe_broadcast(asked, many), "sk", "left_semi").select("sk", parity_bits(F.col("s")).alias("bits")), "sets-bits")
    both = met.join(maybe_broadcast(bits.select(F.col("sk").alias("sk1"), F.col("bits").alias("bits1")), many), "sk1").join(maybe_broadcast(bits.select(F.col("sk").alias("sk2"), F.col("bits").alias("bits2")), many), "sk2")
    return both.filter(_few_bits_differ(num, den)).select("sk1", "root1", "sk2", "root2").unionByName(near).distinct()


def similar(met: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): roots of the pairs whose whole sets are similar enough."""
    asked = stash(met.select(F.col("sk1").alias("sk")).unionByName(met.select(F.col("sk2").alias("sk"))).distinct(), "sets-asked")
    some = sets.join(maybe_broadcast(asked, asked.count()), "sk", "left_semi")
    both = met.join(some.select(F.col("sk").alias("sk1"), F.col("s").alias("s1")), "sk1").join(some.select(F.col("sk").alias("sk2"), F.col("s").alias("s2")), "sk2")
    shared = F.size(F.array_intersect("s1", "s2")).cast("long")
    found = both.filter(shared * (num + den) >= (F.size("s1") + F.size("s2")).cast("long") * num)
    return stash(found.select(F.col("root1").alias("a"), F.col("root2").alias("b")).distinct(), "sets-links")
