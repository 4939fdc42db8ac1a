from collections import Counter, defaultdict

import pytest

from cairn.llm import mixing
from tests.llm.data import docs, rows


def targets(sizes, cycle=3, cap=3):
    """Shares by weight, the excess of capped sources shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % cycle + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / w > cap * sizes[s]]
        if not over:
            return {s: fixed.get(s, rest * weight[s] / w if s not in fixed else None) for s in names}
        fixed |= {s: cap * sizes[s] for s in over}


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_against_plain_python(spark):
    data = rows(n=300)
    got = mixing.mix_sources(docs(spark, data)).collect()
    assert len(got) == len(data)
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in data:
        sizes[r[3]] += words(r[1])
        largest[r[3]] = max(largest[r[3]], words(r[1]))
    want, of = targets(sizes), {r[0]: r[3] for r in data}
    taken = defaultdict(int)
    for r in got:
        assert r.size == words(next(x[1] for x in data if x[0] == r.doc_id))
        assert r.target == pytest.approx(want[of[r.doc_id]]) and r.source_size == sizes[of[r.doc_id]]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.repeats
        taken[of[r.doc_id]] += r.taken
    repeated = 3 * largest[None] + max(largest.values())
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(largest[s], 3 * words("One"), repeated if s is None else 0), s
    again = mixing.mix_sources(docs(spark, data)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_selections_nest(spark):
    """A greater budget only adds documents: thresholds of one hash."""
    data = [(i, "w " * (i % 7 + 1), "en", "abc"[i % 3], 0) for i in range(400)]
    less = {r.doc_id: r.repeats for r in mixing.mix_sources(docs(spark, data), max_repeats=1).collect()}
    more = {r.doc_id: r.repeats for r in mixing.mix_sources(docs(spark, data), max_repeats=3).collect()}
    c = [i for i in less if i % 3 == 2]
    assert all(less[i] <= more[i] for i in c)


@pytest.mark.parametrize("data", [[], [(1, None, None, None, None)], [(1, "", "en", "a", 0), (1, "", "en", "a", 0)]])
def test_nothing_to_mix(spark, data):
    got = mixing.mix_sources(docs(spark, data)).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * len(data)


def test_one_source_only(spark):
    got = mixing.mix_sources(docs(spark, [(i, "a b", "en", "s", 3) for i in range(10)])).collect()
    assert all(r.taken == 2 and r.target == 20.0 for r in got)


def test_rows_without_words_are_taken_three_times_at_most(spark):
    """Sources at their cap, with rows of size 0 whose hash comes first."""
    data = [(i, "" if i % 2 else "a b c", "en", "a" if i < 4 else "b" if i < 10 else "c", 0) for i in range(60)]
    got = mixing.mix_sources(docs(spark, data)).collect()
    assert max(r.repeats for r in got) == 3 and {r.target / r.source_size for r in got if r.source_size} & {3.0}
    kept = mixing.mixed(docs(spark, data))
    assert kept.columns == docs(spark, data).columns
    assert {i: n for i, n in Counter(r.doc_id for r in kept.collect()).items()} == {r.doc_id: r.repeats for r in got if r.repeats}
