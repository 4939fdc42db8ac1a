"""Word shingles of many texts at once, as arrays: XXH64 of shingles, 64-bit SimHashes, sets of shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text taken at once, and shingles hashed at once; a longer text is taken alone.
SLICE, BLOCK = 1 << 20, 1 << 17
#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer spans are hashed one by one.
LONG = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.arange(256)
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
_BLANK = (_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13))


def slices(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The texts in UTF-8, as many at once as make about SLICE bytes."""
    held, size = [], 0
    for t in texts:
        raw = (t or "").encode()
        if held and size + len(raw) > SLICE:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


class Words:
    """The words (runs of anything but ASCII white space, A-Z lower-cased) of some texts, laid end to end, one blank apart."""

    def __init__(self, raws: list[bytes]):
        raw = _LOWER[np.frombuffer(b" ".join(raws) + b" ", np.uint8)]
        blank = _BLANK[raw]
        before = np.concatenate(([True], blank[:-1]))
        first = np.flatnonzero(~blank & before)
        lens = np.flatnonzero(blank & ~before) - first
        raw = np.where(blank, np.uint8(32), raw)
        self.bytes = np.concatenate((raw[~blank | ~before], np.zeros(8, np.uint8)))  # words may be read 8 bytes at once
        self.starts = np.cumsum(lens + 1) - (lens + 1)
        self.ends = self.starts + lens
        edges = np.cumsum([0, *(len(x) + 1 for x in raws)])
        self.of = np.searchsorted(first, edges)  # text i has the words of[i] to of[i + 1]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, last word, offsets by text) of all shingles; fewer words than `width` are one, none have none."""
        n = np.diff(self.of)
        count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        at = np.concatenate(([0], np.cumsum(count)))
        first = np.arange(at[-1]) + np.repeat(self.of[:-1] - at[:-1], count)
        return first, first + np.repeat(np.minimum(n, width), count) - 1, at

    def hashes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """XXH64 (seed 42) of all shingles, and their offsets by text."""
        first, last, at = self.shingles(width)
        out = np.empty(len(first), np.uint64)
        for i in range(0, len(first), BLOCK):
            a = self.starts[first[i : i + BLOCK]]
            out[i : i + BLOCK] = xxh64(self.bytes, a, self.ends[last[i : i + BLOCK]] - a, 42)
        return out, at

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of every word: differences of sums over the bytes times powers, shifted to one place."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + 4 * SLICE, "right")))
            base, size = int(self.starts[i]), int(self.ends[j - 1] - self.starts[i])
            if size > 4 * SLICE:  # one very long word
                out[i] = xxhash.xxh64_intdigest(self.bytes[base : base + size].tobytes(), 42)
            else:
                power, back = _powers(size)
                with np.errstate(over="ignore"):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.bytes[base : base + size].astype(np.uint64) + np.uint64(1)) * power)))
                    a = self.starts[i:j] - base
                    out[i:j] = (sums[self.ends[i:j] - base] - sums[a]) * back[a]
            i = j
        return out

    def sets(self, width: int) -> list[np.ndarray]:
        """By text the sorted 64-bit hashes of its distinct shingles, combined from word hashes."""
        first, last, at = self.shingles(width)
        w = self.word_hashes()
        with np.errstate(over="ignore"):
            h = (last - first + 1).astype(np.uint64)
            for i in range(width):
                inside = first + i <= last
                step = (h ^ (h >> np.uint64(29))) * _BASE + w[np.minimum(first + i, last)] if len(w) else h
                h = step if inside.all() else np.where(inside, step, h)
            h = (h ^ (h >> np.uint64(32))) * _BASE
        h = (h ^ (h >> np.uint64(29))).view(np.int64)
        return [np.unique(h[a:b]) for a, b in zip(at, at[1:], strict=False)]


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The powers 0 to n of the base and of its inverse, as views."""
    if len(_POWERS[0]) <= n:
        for k, x in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n + 1, SLICE), x, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return [_POWERS[0][:n], _POWERS[1][: n + 1]]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the spans of data, which has 8 bytes more than they reach."""
    n, seed_ = len(data), np.uint64(seed)
    eight = np.ndarray((n - 7,), "<u8", data, 0, (1,))  # at every byte
    four = np.ndarray((n - 3,), "<u4", data, 0, (1,))
    with np.errstate(over="ignore"):
        h = np.full(len(starts), seed_ + P5, np.uint64)
        at = starts.copy()
        wide = np.flatnonzero((lens >= 32) & (lens <= LONG))
        if len(wide):
            acc = [np.full(len(wide), x, np.uint64) for x in (seed_ + P1 + P2, seed_ + P2, seed_, seed_ - P1)]
            for k in range(LONG // 32):
                on = np.flatnonzero(lens[wide] >= 32 * (k + 1))
                if not len(on):
                    break
                p = starts[wide[on]] + 32 * k
                for i in range(4):
                    acc[i][on] = _round(acc[i][on], eight[p + 8 * i])
            m = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                m = (m ^ _round(np.uint64(0), a)) * P1 + P4
            h[wide] = m
            at[wide] += lens[wide] // 32 * 32
        h += lens.astype(np.uint64)
        rest = np.where(lens > LONG, 0, starts + lens - at)
        for _ in range(3):
            on = np.flatnonzero(rest >= 8)
            h[on] = _rotl(h[on] ^ _round(np.uint64(0), eight[at[on]]), 27) * P1 + P4
            at[on] += 8
            rest[on] -= 8
        on = np.flatnonzero(rest >= 4)
        h[on] = _rotl(h[on] ^ four[at[on]].astype(np.uint64) * P1, 23) * P2 + P3
        at[on] += 4
        rest[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(rest > 0)
            h[on] = _rotl(h[on] ^ data[at[on]].astype(np.uint64) * P5, 11) * P1
            at[on] += 1
            rest[on] -= 1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(lens > LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lens[i]].tobytes(), seed)
    return h


def simhashes(words: Words, width: int) -> np.ndarray:
    """Signed 64-bit SimHash of every text: XXH64 (seed 42) of word shingles, majority by bit; no word: 0."""
    h, at = words.hashes(width)
    out = np.zeros(len(at) - 1, np.int64)
    for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
        if a < b:
            ones = np.zeros(64, np.int64)
            for j in range(a, b, BLOCK):
                ones += np.unpackbits(h[j : min(b, j + BLOCK)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * ones > b - a, bitorder="little").view(np.int64)[0]
    return out
