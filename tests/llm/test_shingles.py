import random

import numpy as np
import pytest
import xxhash

from cairn.llm import shingles as sh
from tests.llm.data import rows

TEXTS = [r[1] for r in rows(n=80)] + [" a", "a ", "\t\x0b\x0c\r\n", "A\x00b", "É é x   y", "w" * 5000 + " b c", "x " * 3000, ""]


def words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("width", [1, 3, 5])
@pytest.mark.parametrize("size", [1, 500, 1 << 20])
def test_hashes_equal_the_library(width, size, monkeypatch):
    monkeypatch.setattr(sh, "SLICE", size)
    got = []
    for part in sh.slices(TEXTS):
        h, at = sh.Words(part).hashes(width)
        got += [h[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    assert len(got) == len(TEXTS)
    for t, h in zip(TEXTS, got, strict=True):
        w = words(t)
        want = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
        assert h == [xxhash.xxh64_intdigest(x, 42) for x in want]


def test_spans_of_every_length():
    data = np.frombuffer(random.Random(1).randbytes(4000) + bytes(8), np.uint8)
    starts = np.arange(0, 3000)
    lens = np.minimum(starts % 300, 4000 - starts)
    got = sh.xxh64(data, starts, lens, 7)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 7) for a, n in zip(starts, lens, strict=True)]


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_sets_are_equal_where_the_shingles_are(size, monkeypatch):
    monkeypatch.setattr(sh, "SLICE", size)
    got = [x for part in sh.slices(TEXTS) for x in sh.Words(part).sets(5)]
    of = {}
    for t, s in zip(TEXTS, got, strict=True):
        w = words(t)
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        assert len(s) == len(want) and (np.diff(s) > 0).all()
        of.setdefault(frozenset(want), set()).add(s.tobytes())
    assert all(len(x) == 1 for x in of.values())
    one, two = (set(sh.Words([x]).sets(5)[0].tolist()) for x in (b"a b c d e f g h", b"z b c d e f g i"))
    assert len(one & two) == 2 and len(one) == len(two) == 4
