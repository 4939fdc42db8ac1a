"""Toxicity with a convolutional text classifier, trained in numpy.

Words are hashed twice, and their first four letters once; a word's embedding is the sum of the three rows, so that
words of one stem share what is learnt, and a word unseen in training meets another's rows only by a double collision. Filters of one to three words slide over the text, the maximum of each
over all places goes to a logistic output. Embeddings start at zero: words that training never saw say nothing.
Training is AdaGrad over small batches, gradients through the maxima, on all labelled rows: these are dealt into shards,
a file each; a task streams through a shard for an epoch, and after each epoch the shards' weights are averaged (a row of
the table over the shards that moved it). The fifth of the rows whose id's hash says so is held back: on these the learning
rate and the number of epochs are chosen, the score is scaled, and the thresholds for flags are set by language. Candidate
rates are trained side by side for TRIAL epochs, then the best goes on alone.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bit_filter import bit_filter, may_hold
from cairn.llm.common import arrow_batches, crc_mod3, operator, stash, text_key, workspace
from cairn.llm.mixing import hash60

ROWS, DIM, FILTERS, WIDTHS, STEM = 1 << 16, 12, 8, (1, 2, 3), 4
MAX_WORDS, BATCH_WORDS = 300_000, 1 << 15
#: Learning rates to choose from.
RATES = (0.003, 0.01, 0.03)
#: Epochs after which the losses of all rates are compared, and the share of the loss that an epoch must gain at least to be worth another.
TRIAL, GAIN = 2, 0.01
#: Rows of a shard, on average at most; rows of the table that are averaged at once.
SHARD_ROWS, BLOCK = 32768, 1 << 13
#: Into how many parts a join deals rows; which files a task reads.
JOINED = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
FILES = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
_WORD = re.compile(r"[^\W_]+")


class WordIds(dict):
    """The three table rows of a word, packed; bounded."""

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        rows = [zlib.crc32(raw), zlib.crc32(b"\x01" + raw), zlib.crc32(b"\x02" + word[:STEM].encode())]
        v = sum((r % ROWS) << (16 * i) for i, r in enumerate(rows))
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = v
        return v


_IDS = WordIds()


def word_ids(text: str | None) -> np.ndarray:
    """Table rows (words x 3) of all words of the whole text, lower-cased."""
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_IDS.__getitem__, words), np.uint64, len(words)).view(np.uint16).reshape(-1, 4)[:, :3].astype(np.int32)


@dataclass
class Network:
    table: np.ndarray = field(default_factory=lambda: np.zeros((ROWS + 1, DIM), np.float32))  # the last row stays zero
    kernels: list[np.ndarray] = field(default_factory=list)  # by width: width x DIM x FILTERS
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    offset: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def rows(self, ids: np.ndarray) -> np.ndarray:
        out = self.table.take(ids[:, 0], axis=0)
        out += self.table.take(ids[:, 1], axis=0)
        out += self.table.take(ids[:, 2], axis=0)
        return out

    def responses(self, x: np.ndarray, n: int) -> np.ndarray:
        """n x (widths * FILTERS): every filter at every place."""
        return self.planes(x, n).T

    def planes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The same, place by place in memory for each filter, from one product."""
        each = np.concatenate([k.transpose(0, 2, 1).reshape(-1, DIM) for k in self.kernels]) @ x.T
        out, i = np.empty((len(WIDTHS) * FILTERS, n), each.dtype), 0
        for k, w in enumerate(WIDTHS):
            y = out[k * FILTERS : (k + 1) * FILTERS]
            y[:] = each[i : i + FILTERS, :n]
            for o in range(1, w):
                y += each[i + o * FILTERS : i + (o + 1) * FILTERS, o : o + n]
            i += w * FILTERS
        return out

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        """The maxima by document. Documents are laid end to end, apart by zero rows; none reaches into the next."""
        gap = max(WIDTHS) - 1
        lens = np.array([max(1, len(d)) for d in docs])
        starts = np.concatenate(([0], np.cumsum(lens + gap)))
        ids = np.full((starts[-1] + gap, 3), ROWS, np.int32)
        for s, d in zip(starts, docs, strict=False):
            ids[s : s + len(d)] = d
        y = self.planes(self.rows(ids), starts[-1])
        return np.stack([y[:, s : s + n].max(axis=1) for s, n in zip(starts, lens, strict=False)])

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.maximum(self.pooled(docs) + self.bias, 0) @ self.out + self.offset

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """Scores 0 to 1."""
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(docs) + b, -40, 40)))

    def raw(self, docs: list[np.ndarray]) -> np.ndarray:
        """Scores before scaling, a bounded number of words at a time; the maxima of a very long text are joined from parts."""
        z, held, size = [], [], 0
        for d in docs:
            if held and size + len(d) > BATCH_WORDS:
                z.append(self.logits(held))
                held, size = [], 0
            if len(d) > 2 * BATCH_WORDS:
                if held:
                    z.append(self.logits(held))
                    held, size = [], 0
                gap = max(WIDTHS) - 1
                parts = [self.pooled([d[i : i + BATCH_WORDS + gap]]) for i in range(0, len(d), BATCH_WORDS)]
                z.append(np.maximum(np.max(parts, axis=0) + self.bias, 0) @ self.out + self.offset)
            else:
                held.append(d)
                size += len(d)
        if held:
            z.append(self.logits(held))
        return np.concatenate(z) if z else np.empty(0)


def places(net: Network, ids: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """By document and filter the place of the greatest response, a bounded number of words at a time."""
    gap = max(WIDTHS) - 1
    if starts[-1] <= 2 * BATCH_WORDS:
        r = net.planes(net.rows(ids), starts[-1])
        return np.stack([s + r[:, s : s + n].argmax(axis=1) for s, n in zip(starts, lens, strict=False)])
    out = []
    for s, n in zip(starts, lens, strict=False):
        top, at = None, None
        for i in range(s, s + n, BATCH_WORDS):
            m = min(BATCH_WORDS, s + n - i)
            r = net.planes(net.rows(ids[i : i + m + gap]), m)
            p = r.argmax(axis=1)
            v = r[np.arange(len(r)), p]
            top, at = (v, i + p) if top is None else (np.maximum(top, v), np.where(v > top, i + p, at))
        out.append(at)
    return np.stack(out)


def gradients(net: Network, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Mean weighted loss of a batch; its gradients by kernels, bias and output; by the offset; by rows of the table (rows, gradients)."""
    gap = max(WIDTHS) - 1
    lens = np.array([max(1, len(d)) for d in docs])
    starts = np.concatenate(([0], np.cumsum(lens + gap)))
    ids = np.full((starts[-1] + gap, 3), ROWS, np.int32)
    for s, d in zip(starts, docs, strict=False):
        ids[s : s + len(d)] = d
    at = places(net, ids, starts, lens)
    met = lambda p: net.rows(ids[p].reshape(-1, 3)).reshape(*p.shape, -1)  # noqa: E731  embeddings at places
    cols = [slice(k * FILTERS, (k + 1) * FILTERS) for k in range(len(WIDTHS))]
    xs = [[met(at[:, c] + o) for o in range(w)] for c, w in zip(cols, WIDTHS, strict=True)]
    pool = np.concatenate([sum(np.einsum("bfd,df->bf", x, k[o]) for o, x in enumerate(part)) for part, k in zip(xs, net.kernels, strict=True)], axis=1) + net.bias
    act = np.maximum(pool, 0)
    z = act @ net.out + net.offset
    loss = float((weight * (np.logaddexp(0, z) - y * z)).mean())
    g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight / len(docs)).astype(np.float32)
    g_pool = g[:, None] * net.out * (pool > 0)
    grads, rows, moved = [], [], []
    for k, (w, kernel) in enumerate(zip(WIDTHS, net.kernels, strict=True)):
        p, gp = at[:, cols[k]], g_pool[:, cols[k]]
        grads.append(np.stack([np.einsum("bfd,bf->df", x, gp) for x in xs[k]]))
        for o in range(w):
            rows.append(ids[p + o].reshape(-1, 3))
            moved.append((gp[:, :, None] * kernel[o].T).reshape(-1, DIM))
    grads += [g_pool.sum(axis=0), act.T @ g]
    rows, moved = np.concatenate(rows), np.concatenate(moved)
    known = (moved != 0).any(axis=1)
    rows, moved = rows[known].ravel(), np.repeat(moved[known], 3, axis=0)
    moved, rows = moved[rows < ROWS], rows[rows < ROWS]
    where, of = np.unique(rows, return_inverse=True)
    total = np.zeros((len(where), DIM), np.float32)
    np.add.at(total, of, moved)
    return loss, grads, float(g.sum()), where, total


@dataclass
class Training:
    """A network with the sums of squares of AdaGrad."""

    net: Network
    rate: float
    grown: list[np.ndarray]
    squares: np.ndarray
    off_sq: float = 1e-8

    def dense(self) -> list[np.ndarray]:
        return [*self.net.kernels, self.net.bias, self.net.out]

    def flat(self) -> np.ndarray:
        """All but the table and its squares, end to end."""
        return np.concatenate([*(p.ravel() for p in [*self.dense(), *self.grown]), [self.net.offset, self.off_sq]]).astype(np.float64)

    def unflatten(self, v: np.ndarray) -> None:
        i = 0
        for p in [*self.dense(), *self.grown]:
            p[...] = v[i : i + p.size].reshape(p.shape)
            i += p.size
        self.net.offset, self.off_sq = float(v[i]), float(v[i + 1])


def start(rate: float, seed: int = 7) -> Training:
    rng = np.random.default_rng(seed)
    net = Network(kernels=[rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS])
    net.out = np.abs(rng.normal(0.5, 0.1, len(WIDTHS) * FILTERS)).astype(np.float32) * np.where(np.arange(len(WIDTHS) * FILTERS) % 4 == 3, -1, 1).astype(np.float32)
    net.bias += 0.1
    net.offset = -1.0
    return Training(net, rate, [np.full(p.shape, 1e-8, np.float32) for p in (*net.kernels, net.bias, net.out)], np.full(ROWS + 1, 1e-8, np.float32))


def train_epoch(tr: Training, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, seed: tuple[int, ...], batch: int = 16) -> None:
    """One pass over a shard's rows, in place."""
    net, order = tr.net, np.random.default_rng(seed).permutation(len(docs))
    for i in range(0, len(order), batch):
        part = order[i : i + batch]
        _, grads, g_off, where, moved = gradients(net, [docs[j] for j in part], labels[part], weight[part])
        for p, g, s in zip(tr.dense(), grads, tr.grown, strict=True):
            s += g * g
            p -= tr.rate * g / np.sqrt(s)
        tr.off_sq += g_off * g_off
        net.offset -= tr.rate * g_off / np.sqrt(tr.off_sq)
        tr.squares[where] += (moved * moved).mean(axis=1)
        net.table[where] -= 5 * tr.rate * moved / np.sqrt(tr.squares[where])[:, None]


def unpack(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.uint16).reshape(-1, 3).astype(np.int32)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str) -> DataFrame:
    """Every labelled row with a document, as h, t (hashes of id and text), y, lang, back (held back), ids (its words) and shard; a file a shard."""
    marked = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"), hash60(F.col(id_col)).alias("h"))
    x = lambda c: F.xxhash64(F.col(c).cast("string")).alias("x")
    many = marked.count()
    number = max(1, -(-many // SHARD_ROWS))
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(marked.select(x("_id")), many) if many else None)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if wanted.value is not None:  # texts without a label go no further, but for a few
                b = b.filter(pa.array(may_hold(wanted.value, b.column(0).to_numpy())))
            ids = pa.array([word_ids(t.as_py()).astype(np.uint16).tobytes() for t in b.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:4], ids], names=["_d", "t", "lang", "ids"])

    rows = docs.select(x(id_col), F.col(id_col).alias("_d"), text_key(F.col(text_col)).alias("t"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, f"_d {docs.schema[id_col].dataType.simpleString()}, t long, lang string, ids binary").repartition(number, "_d")
    rows = rows.join(marked.repartition(number, "_id").hint("merge"), F.col("_d") == F.col("_id"))  # where the rows lie
    rows = rows.select("h", "t", "y", "lang", (F.col("h") % 5 == 4).alias("back"), "ids").sortWithinPartitions("h", "t", "y", "lang")
    with settings(docs.sparkSession, JOINED, number):  # the join takes the shards as they are
        return stash(rows.withColumn("shard", F.spark_partition_id()), "toxic-rows")


@contextmanager
def settings(spark: SparkSession, names: list[str], value: int) -> Iterator[None]:
    """Meanwhile these settings have this value."""
    before = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, str(value))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def often(rows: DataFrame) -> np.ndarray:
    """Which rows of the table three training texts or more use: words and stems of one or two would only be learnt by heart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(ROWS + 1, np.int64)
        for b in batches:
            for ids in b.column(0):
                seen[np.unique(unpack(ids.as_py()))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["row", "n"])

    counts = rows.filter("not back").select("ids").mapInArrow(run, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).filter("n >= 3")
    out = np.zeros(ROWS + 1, bool)
    out[[r["row"] for r in counts.collect()]] = True  # as many as the table has, at most
    out[ROWS] = False
    return out


def fit(rows: DataFrame, rates: tuple[float, ...], epochs: int = 12, patience: int = 3) -> Network:
    """The network of the rate and epoch with the least loss on the held-back rows, scaled, with thresholds."""
    spark = rows.sparkSession
    counts = {(r["back"], r["y"]): r["n"] for r in rows.groupBy("back", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = (counts.get((False, y), 0) for y in (1, 0))
    if not n1 or not n0:
        net = start(rates[0]).net
        net.scale = (0.0, 4.0 if n1 else -4.0)
        return net
    weights = 0.5 * (n0 + n1) / n0, 0.5 * (n0 + n1) / n1
    seen = often(rows)
    state = {i: start(rate) for i, rate in enumerate(rates)}
    kept: dict[int, tuple[float, Network]] = {}
    waited, mark = dict.fromkeys(state, 0), dict.fromkeys(state, np.inf)
    for epoch in range(epochs + 1):
        with arrow_batches(spark), settings(spark, FILES, 1 << 40):  # a task a file, so that its rows are those of one shard
            got = one_epoch(rows, state, seen, weights, epoch, epoch < epochs)
        for i, (loss, flat, moved) in got.items():
            tr = state[i]
            if epoch:
                waited[i] += 1
                if i not in kept or loss < kept[i][0]:
                    kept[i] = loss, pickle.loads(pickle.dumps(tr.net))
                if loss < mark[i] * (1 - GAIN):
                    mark[i], waited[i] = loss, 0
            tr.unflatten(flat)
            for where, table, squares in moved:
                tr.net.table[where], tr.squares[where] = table, squares
        best = min(kept, key=lambda i: (kept[i][0], i), default=None)
        state = {i: tr for i, tr in state.items() if waited[i] < patience and (epoch < TRIAL or i == best)}
        if not state:
            break
    net = kept[best][1]
    if any(back for back, _ in counts):
        calibrate(net, rows)
    return net


def one_epoch(rows: DataFrame, state: dict[int, Training], seen: np.ndarray, weights: tuple[float, float], epoch: int, training: bool) -> dict:
    """By rate: the loss on held-back rows before this epoch, and what the shards' weights are on average after it: those of `flat`, and table rows."""
    held = rows.sparkSession.sparkContext.broadcast((state, seen, weights, epoch, training))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen, weights, epoch, training = held.value
        own = pickle.loads(pickle.dumps(first))
        losses, shard, backs, used = dict.fromkeys(own, 0.0), None, 0, 0
        for number, b in enumerate(batches):
            if not b.num_rows:
                continue
            shard, labels, back = b.column(0)[0].as_py(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            words = [unpack(x.as_py()) for x in b.column(3)]
            weight = np.where(labels == 1, weights[1], weights[0]).astype(np.float32)
            backs += int(back.sum())
            docs = []
            for i in np.flatnonzero(~back) if training else ():
                d = np.where(seen[words[i]], words[i], ROWS).astype(np.int32)
                d[(d[:, :2] == ROWS).any(axis=1), :2] = ROWS  # a word needs both of its rows
                docs.append(d)
            used += len(docs)
            for rate, tr in own.items():
                if back.any():
                    z, y = first[rate].net.raw([words[i] for i in np.flatnonzero(back)]), labels[back]
                    losses[rate] += float((weight[back] * (np.logaddexp(0, z) - y * z)).sum())
                train_epoch(tr, docs, labels[~back], weight[~back], (7, epoch, shard, number))
        for rate, tr in own.items() if shard is not None else ():
            where = np.flatnonzero((tr.net.table != first[rate].net.table).any(axis=1))
            parts = [(-1, (losses[rate], backs, used, tr.flat()))]
            for k in np.unique(where // BLOCK).tolist():
                at = where[where // BLOCK == k]
                parts.append((k, (at, tr.net.table[at], tr.squares[at])))
            yield pa.RecordBatch.from_pydict({"rate": pa.array([rate] * len(parts), pa.int32()), "block": pa.array([k for k, _ in parts], pa.int32()), "shard": pa.array([shard] * len(parts), pa.int64()), "state": [pickle.dumps(x) for _, x in parts]})

    def average(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")  # the same sums each time
        parts = [pickle.loads(x.as_py()) for x in rows.column("state")]
        if rows.column("block")[0].as_py() < 0:
            backs, used = sum(x[1] for x in parts), sum(x[2] > 0 for x in parts)
            out = sum(x[0] for x in parts) / max(1, backs), sum(x[3] * (x[2] > 0) for x in parts) / used if used else parts[0][3]
        else:
            at = np.unique(np.concatenate([x[0] for x in parts]))
            n, table, squares = np.zeros(len(at)), np.zeros((len(at), DIM)), np.zeros(len(at))
            for where, t, q in parts:
                i = np.searchsorted(at, where)
                n[i] += 1
                table[i] += t
                squares[i] += q
            out = at, (table / n[:, None]).astype(np.float32), (squares / n).astype(np.float32)
        return pa.Table.from_arrays([rows.column("rate")[:1], rows.column("block")[:1], pa.array([pickle.dumps(out)], pa.binary())], names=["rate", "block", "state"])

    done = rows.select("shard", "y", "back", "ids").mapInArrow(run, "rate int, block int, shard long, state binary")
    got = done.groupBy("rate", "block").applyInArrow(average, "rate int, block int, state binary").collect()
    held.unpersist()
    out = {}
    for i in state:
        mine = {r["block"]: pickle.loads(r["state"]) for r in got if r["rate"] == i}
        loss, flat = mine.pop(-1)
        out[i] = loss, flat, list(mine.values())
    return out


def calibrate(net: Network, rows: DataFrame) -> None:
    """Scale and thresholds by all held-back rows."""
    held = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in batches:
            z = net.raw([unpack(x.as_py()) for x in b.column(2)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.float64())], names=["y", "lang", "z"])

    with arrow_batches(rows.sparkSession):
        got = stash(rows.filter("back").select("y", "lang", "ids").mapInArrow(run, "y int, lang string, z double"), "toxic-back")
    net.scale = _platt(got)
    _thresholds(net, got)


def _platt(rows: DataFrame) -> tuple[float, float]:
    """Scale and shift of the logits (y, z) by Newton steps on the smoothed likelihood; the slope stays positive."""
    n1, n0 = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    t, z = F.when(F.col("y") == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2)), F.col("z")
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * z + b))))
        g, w = (p - t).alias("g"), (p * (1 - p) + 1e-6).alias("w")
        s = rows.select("z", g, w).agg(F.sum(F.col("g") * z), F.sum("g"), F.sum(F.col("w") * z * z), F.sum(F.col("w") * z), F.sum("w")).first()
        h = np.array([[s[2], s[3]], [s[3], s[4]]]) + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(h, np.array(s[:2])), -1, 1)
        was = a, b
        a, b = max(a - step[0], 0.05), b - step[1]
        if max(abs(a - was[0]), abs(b - was[1])) < 1e-8:
            break
    return round(float(a), 6), round(float(b), 6)  # whatever the order of the sums


def _thresholds(net: Network, rows: DataFrame) -> None:
    """By language the cut (in thousandths) with the best F1 on held-back rows (y, lang, z); few rows: the cut over all."""
    a, b = net.scale
    s = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), a * F.col("z") + b))))
    rows = rows.select("y", "lang", F.floor(s * 1000).cast("int").alias("at"), F.rint(s * 1000).cast("int").alias("cut"))

    def best(counts: list) -> float:
        above = np.zeros((2, 1002), np.int64)
        for r in counts:
            above[r["y"], r["at"]] += r["n"]
        above = above[:, ::-1].cumsum(axis=1)[:, ::-1]
        cuts = np.unique([r["cut"] for r in counts])
        f1 = 2 * above[1, cuts] / np.maximum(1, above.sum(axis=0)[cuts] + above[1, 0])
        return float(cuts[f1 >= f1.max() - 1e-12].mean() / 1000)

    net.threshold = best(rows.groupBy("y", "at", "cut").agg(F.count(F.lit(1)).alias("n")).collect())
    many = rows.filter("lang <> ''").groupBy("lang").agg(F.sum("y").alias("y1"), F.count(F.lit(1)).alias("n")).filter("y1 >= 10 and n - y1 >= 10").select("lang")
    by: dict[str, list] = {}
    for r in rows.join(many, "lang").groupBy("lang", "y", "at", "cut").agg(F.count(F.lit(1)).alias("n")).collect():  # up to 2,000 a language
        by.setdefault(r["lang"], []).append(r)
    net.thresholds = {lang: best(x) for lang, x in by.items()}


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", rates: tuple[float, ...] = RATES) -> Network:
    """Fit on all rows with a label of 0 or 1, on their whole texts."""
    with workspace(docs.sparkSession), arrow_batches(docs.sparkSession):
        return fit(labelled(docs, labels, id_col, text_col, lang_col, label_col), rates)


@operator
def score(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, score (0 to 1), flagged (by the threshold of the row's language, if there is such a column) of every whole text; null and empty texts get the score of a text without words. Repeated rows repeat."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in batches:
            s = net.scores([word_ids(t.as_py()) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64())], names=["id", "lang", "score"])

    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), lang.cast("string").alias("lang"))
    out = rows.mapInArrow(run, "id long, lang string, score double")
    cut = F.lit(net.threshold)
    for name, value in sorted(net.thresholds.items()):
        cut = F.when(F.col("lang") == name, value).otherwise(cut)
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= cut).alias("flagged"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cutoff: float = 0.7, **bounds) -> DataFrame:
    """Train outside the held-out third (crc32 of the id, mod 3, is 1), score all: id, held_out, score, predicted, flagged.

    predicted: score >= cutoff. flagged: score >= the threshold of the row's language; the language enters no score.
    """
    net = train(docs, labels.filter(crc_mod3(F.col(id_col)) != 1), id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    out = score(docs, net, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return out.select(id_col, (crc_mod3(F.col(id_col)) == 1).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), "flagged")
