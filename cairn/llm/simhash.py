"""SimHash near-duplicates through an inverted index of fingerprint bytes with count filtering.

Fingerprints of 64 bits that differ in at most d bits agree in at least 8 - d of their 8 bytes (5 for d = 3), so of
any k + d byte positions such a pair shares at least k. The index posts each distinct fingerprint under every choice
of k of the first k + d positions, and no pair is lost; k grows with the number of fingerprints, so that lists stay
short. Within a list the shared positional bytes are tallied per pair, pairs below the guaranteed minimum go, the
rest is verified by bit count. A list yields a spanning forest of its links, never all pairs of a group; a list above
a bound is not held but dealt again under further bits, d + 1 blocks of which one must be equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import arrow_batches, gives_back, maybe_broadcast, operator, stash, text_key, without
from cairn.llm.components import connected_components
from cairn.llm.shingles import Words, simhashes, slices

BYTES = 8
#: Fingerprints that a posting list is expected to hold, that are compared at once, and that one task holds.
EXPECTED, DENSE, HELD = 16, 512, 1 << 16
EDGES = "mask long, a long, b long"


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (tells texts of one id apart) and text."""
    return docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fp = np.concatenate([simhashes(Words(part), width) for part in slices(b.column(2).to_pylist())])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["id", "th", "fp"])

    return identified(docs, id_col, text_col).mapInArrow(run, "id long, th long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks(n: int, distance: int) -> list[int]:
    """The bits of every choice of k of the first k + distance bytes, k by the number of fingerprints."""
    if not 0 <= distance < BYTES:
        raise ValueError("distances from 0 to 7 bits leave an equal byte")
    k = 1
    while k < BYTES - distance and n > EXPECTED << (8 * k):
        k += 1
    return [sum(255 << (8 * p) for p in at) for at in combinations(range(k + distance), k)]


def further_masks(mask: int, distance: int) -> list[int]:
    """The mask with each of distance + 1 blocks of the bits it lacks; a link agrees in one block at least."""
    left = [i for i in range(64) if not mask >> i & 1]
    whole = [p for p in range(BYTES) if not mask >> (8 * p) & 255]
    if len(whole) > distance:
        return [mask | 255 << (8 * p) for p in whole[: distance + 1]]
    cut = [len(left) * i // (distance + 1) for i in range(distance + 2)]
    return [mask | sum(1 << i for i in left[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def linked(x: np.ndarray, distance: int) -> np.ndarray:
    """Which of these xors belong to links: count filter on equal bytes, then the bits themselves."""
    near = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - distance
    near[near] = np.bitwise_count(x[near]) <= distance
    return near


Pairs = list[tuple[np.ndarray, np.ndarray]]


def forest(fps: np.ndarray, distance: int, patience: int) -> tuple[Pairs, bool]:
    """A spanning forest of the links among these distinct fingerprints; False if it took more than `patience` steps and is not whole."""
    left, queue, out = fps, [], []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        if not patience:
            return out, not len(left)
        patience -= 1
        v = queue.pop()
        hit = linked(left ^ v, distance)
        if hit.any():
            found = left[hit]
            out.append((np.full(len(found), v), found))
            queue.extend(found)
            left = left[~hit]
    return out, True


def list_links(fps: np.ndarray, mask: int, distance: int) -> Pairs:
    """Links that connect whatever is linked among these distinct fingerprints, which agree in the bits of the mask."""
    n = len(fps)
    if n <= 16 or n > DENSE:
        out, whole = forest(fps, distance, n if n <= 16 else 64 + n // 64)  # a ball of near copies is done in a few steps
        if whole:
            return out
        for child in further_masks(mask, distance):
            key = fps & np.uint64(child)
            order = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
            size = np.diff(np.append(at, n))
            for i, m in zip(at[size > 1], size[size > 1], strict=True):
                out += list_links(fps[order[i : i + m]], child, distance)
        return out
    i, j = np.triu_indices(n, 1)
    hit = linked(fps[i] ^ fps[j], distance)
    if hit.sum() > 2 * n:
        return forest(fps, distance, n)[0]
    return [(fps[i[hit]], fps[j[hit]])]


def links_of_lists(post: DataFrame, distance: int) -> DataFrame:
    """post (mask, key, fp) -> edges (mask 0, a, b), and the rows of lists that are too long to hold (their mask, a = fp)."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of one list
        over = None
        for b in batches:
            m, k, fp = (c.to_numpy() for c in b.columns)
            if not len(m):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (k[1:] != k[:-1]))))
            s, z = 0, int(starts[-1])  # the last list may go on in the next batch
            if over == (m[0], k[0]):
                s = int(starts[1]) if len(starts) > 1 else len(m)
                yield later(m[:s], fp[:s])
                if s == len(m):
                    continue
            over = None
            if held and (held[0][0][0], held[0][1][0]) != (m[s], k[s]):
                yield of(held)
                held = []
            if z > s:
                yield of([*held, (m[s:z], k[s:z], fp[s:z])])
                held = []
            held.append((m[z:], k[z:], fp[z:]))
            if sum(len(x[0]) for x in held) > HELD:
                over = (m[-1], k[-1])
                for x in held:
                    yield later(x[0], x[2])
                held = []
        if held:
            yield of(held)

    def later(m: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(m), pa.array(fp), pa.array(fp)], names=["mask", "a", "b"])

    def of(held: list[tuple]) -> pa.RecordBatch:
        m, k, fp = (np.concatenate(c) for c in zip(*held, strict=True))
        fp = fp.view(np.uint64)
        new = np.concatenate(([True], (m[1:] != m[:-1]) | (k[1:] != k[:-1])))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(fp)))
        two = at[size == 2]
        hit = linked(fp[two] ^ fp[two + 1], distance)
        found = [(fp[two][hit], fp[two + 1][hit])]
        for i, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found += list_links(fp[i : i + n], int(m[i]) % (1 << 64), distance)
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int64)), pa.array(a), pa.array(b)], names=["mask", "a", "b"])

    dealt = post.repartition("mask", "key").sortWithinPartitions("mask", "key")
    with arrow_batches(post.sparkSession, 20_000):  # three numbers a row
        return stash(dealt.mapInArrow(run, EDGES), "simhash-links")


def postings(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, fp): each distinct fingerprint under every mask."""
    keys = [F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for m in masks]
    return fps.select("fp", F.explode(F.array(*keys)).alias("p")).select("p.mask", "p.key", "fp")


def links(fps: DataFrame, distance: int, n: int | None = None) -> DataFrame:
    """(a, b): links that connect all linked ones of these distinct fingerprints."""
    post = postings(fps.select("fp"), first_masks(fps.count() if n is None else n, distance))
    out = None
    while True:
        got = links_of_lists(post, distance)
        edges = got.filter("mask = 0").select("a", "b")
        out = edges if out is None else out.unionByName(edges)
        masks = [r["mask"] for r in got.filter("mask <> 0").select("mask").distinct().collect()]  # of the index, not of the data
        if not masks:
            return out
        more = [(m, [signed(x) for x in further_masks(m % (1 << 64), distance)]) for m in masks]
        more = F.broadcast(fps.sparkSession.createDataFrame(more, "mask long, next array<long>"))
        post = got.filter("mask <> 0").join(more, "mask").select(F.col("a").alias("fp"), F.explode("next").alias("mask"))
        post = post.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct()


def near_rows(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int, set_width: int, similarity: tuple[int, int] | None) -> tuple[DataFrame, DataFrame]:
    """Every row as (id, th, fp), and the root of every distinct fingerprint as (fp, root)."""
    from cairn.llm import similar_sets

    if similarity:
        base = similar_sets.describe(docs, id_col, text_col, width, set_width, similarity)
    else:
        base = stash(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = stash(base.select("fp").distinct(), "simhash-classes")
    edges = links(classes, distance)
    if similarity:
        edges = edges.unionByName(similar_sets.equal_sets(base))
    nodes = relabelled(classes.withColumn("root", F.col("fp")), connected_components(edges))
    if similarity:
        nodes = similar_sets.merge(docs, base, nodes, id_col, text_col, set_width, similarity)
    return base.select("id", "th", "fp"), nodes


def relabelled(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """nodes with their roots replaced through moved (node, root)."""
    moved = stash(moved.select(F.col("node").alias("_node"), F.col("root").alias("_to")), "simhash-moved")
    out = nodes.join(maybe_broadcast(moved, moved.count()), F.col("root") == F.col("_node"), "left")
    return stash(out.withColumn("root", F.coalesce("_to", "root")).drop("_node", "_to"), "simhash-roots")


@operator
def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, set_width: int = 5, similarity: tuple[int, int] | None = None) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    With `similarity` (a fraction), texts whose sets of `set_width`-word shingles are that similar are linked as well.

    Null, empty and blank texts have fingerprint zero and link like any other. Equal fingerprints are one node, so
    repeated rows and groups of copies cost nothing beyond their count. Rows without an id get the smallest id of
    their component, null if it has none. An empty table gives an empty result; other columns are not read.
    """
    rows, nodes = near_rows(docs, id_col, text_col, width, distance, set_width, similarity)
    reps = nodes.join(rows.groupBy("fp").agg(F.min("id").alias("rep")), "fp")
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = stash(nodes.join(least, "root").select(F.col("fp").alias("f"), "component_id"), "simhash-components")
    out = rows.join(of, F.col("fp") == F.col("f"))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@operator
def surplus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, set_width: int = 5, similarity: tuple[int, int] | None = None) -> DataFrame:
    """(id, th, kept): every row; kept is that of the smallest id of its component (no id comes last; ties by text)."""
    rows, nodes = near_rows(docs, id_col, text_col, width, distance, set_width, similarity)
    # Only components of several fingerprints, and fingerprints of several rows, are compared.
    shared = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("root")
    many = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp")
    of = nodes.join(shared, "root").select("fp", "root").unionByName(nodes.join(many, "fp").select("fp", "root"))
    of = stash(of.distinct(), "simhash-shared")
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", "th")
    rows = stash(rows.join(maybe_broadcast(of, of.count()), "fp", "left").select("root", "id", "th", key.alias("key")), "simhash-rows")
    first = rows.filter("root is not null").groupBy("root").agg(F.min("key").alias("first"))
    together = rows.filter("root is not null").join(first, "root").select("id", "th", (F.col("key") == F.col("first")).alias("kept"))
    return rows.filter("root is null").select("id", "th", F.lit(True).alias("kept")).unionByName(together)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that of the smallest id, without an id last, ties by text.

    Rows are told apart by id and text, so other texts under the id of a dropped copy stay. Of rows that repeat both,
    one stays.
    """
    rows = surplus(docs, id_col=id_col, text_col=text_col, **kw)
    return without(docs, rows, rows.filter("not kept"), id_col, text_key(F.col(text_col)))
