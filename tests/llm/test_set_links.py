import hashlib
import random

import corpus_pipeline as cp

from cairn.llm import similar_sets
from tests.llm.data import docs
from tests.llm.test_simhash import brute_fingerprint, classes


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def corpus():
    rng = random.Random(9)
    line = [f"license{i}" for i in range(12)]  # a passage that most texts share
    data = []
    for i in range(60):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(3, 150))]
        for copy in range(3):
            words = list(base)
            for _ in range(rng.randint(0, 4) if copy else 0):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
            data.append((3 * i + copy, " ".join(words + (line if i % 3 else [])), "en", "s", 0))
    return data


def test_stage_takes_copies_at_four_fifths(spark):
    data = corpus()
    text = [r[1] for r in data]
    sets, fp = [shingles(x) for x in text], [brute_fingerprint(x) for x in text]
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    pairs = [(a, b) for a in range(len(data)) for b in range(a)]
    bits = [p for p in pairs if (fp[p[0]] ^ fp[p[1]]).bit_count() <= 3]
    want = classes(len(data), bits + [p for p in pairs if near(*p)])
    assert len(set(want)) < len(set(classes(len(data), bits))) - 10  # three bits miss many
    got = {r.doc_id for r in cp.near(spark, docs(spark, data), "").collect()}
    assert got == set(want)


def test_links_in_long_lists(spark):
    """Copies of one text with so many changes that some pairs are similar and most are not, and a passage that all texts share."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    data = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
        data.append((i, " ".join(words[: rng.randint(90, 120)]), "en", "s", 0))
    passage = " ".join(f"p{i}" for i in range(60))
    data += [(200 + i, f"{passage} " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(10, 200))), "en", "s", 0) for i in range(60)]
    data += [(300, "one two", "en", "s", 0), (301, "one two", "en", "s", 0), (302, None, "en", "s", 0), (303, "ONE  two\n", "en", "s", 0)]
    sets, fp = [shingles(r[1] or "") for r in data], [brute_fingerprint(r[1]) for r in data]
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    links = [(a, b) for a in range(len(data)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3 or near(a, b)]
    want = {data[r][0] for r in classes(len(data), links)}
    for worth in (0.5, 0.95):
        similar_sets.WORTH = worth
        assert {r.doc_id for r in cp.near(spark, docs(spark, data), "").collect()} == want
    similar_sets.WORTH = 0.5
    similar_sets.MAX_FILTER_BITS, most = 0, similar_sets.MAX_FILTER_BITS  # no filter: the same by a join
    assert {r.doc_id for r in cp.near(spark, docs(spark, data), "").collect()} == want
    similar_sets.MAX_FILTER_BITS = most
    assert 1 < len(want) < len(data) - 20


def test_few_pairs_are_compared_in_a_large_group(spark, monkeypatch):
    """Copies of one text of which most pairs are just not similar: what the last round compares is not all pairs, and no link is lost."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    data = []
    for i in range(160):
        words = list(base)
        for k in rng.sample(range(200), rng.randint(2, 5)):
            words[k] = f"n{rng.randint(0, 10**6)}"
        data.append((i, " ".join(words), "en", "s", 0))
    sets = [shingles(r[1]) for r in data]
    similar = [(a, b) for a in range(len(data)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    compared, was = [], similar_sets.all_open

    def counted(*args):
        met = was(*args)
        compared.append(met.count())
        return met

    monkeypatch.setattr(similar_sets, "all_open", counted)
    monkeypatch.setattr(similar_sets, "LEADERS", 1)
    fp = [brute_fingerprint(r[1]) for r in data]
    bits = [(a, b) for a in range(len(data)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3]
    assert {r.doc_id for r in cp.near(spark, docs(spark, data), "").collect()} == set(classes(len(data), bits + similar))
    assert len(similar) > 50
    assert sum(compared) <= 2 * len(similar)


def join_rows(spark, run):
    """The rows that joins make while this runs, by Spark's own count."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, out = store.executionsCount(), run()
    executions, total = store.executionsList(), 0
    for i in range(before, executions.size()):
        number = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for k in range(nodes.size()):
            metrics = nodes.apply(k).metrics()
            for j in range(metrics.size() if "Join" in nodes.apply(k).name() else 0):
                m = metrics.apply(j)
                if m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                    total += int(values.get(m.accumulatorId()).get().replace(",", ""))
    return out, total


def test_joins_make_few_rows_in_a_large_group(spark, monkeypatch):
    """Many copies under one root and many that are not similar to them, though they share most of their shingles: twice as many make about twice the rows, and no link is lost."""
    made = []
    for size in (150, 300):
        rng = random.Random(size)
        base = [f"w{i}" for i in range(200)]
        sets, far = [], base
        for i in range(size):
            words = list(far if i % 6 == 3 else base)  # every other one that is far from the base has one near it
            for k in rng.sample(range(200), 2 if i % 3 else 1 if i % 6 else rng.randint(5, 8)):
                words[k] = f"n{rng.randint(0, 10**6)}"
            far = far if i % 3 else words
            sets.append([int.from_bytes(hashlib.md5(" ".join(x).encode()).digest()[:8], "big", signed=True) for x in shingles(" ".join(words))])
        near = lambda a, b: 9 * len({*sets[a]} & {*sets[b]}) >= 4 * (len(sets[a]) + len(sets[b]))
        roots = classes(size, [(a, b) for a in range(size) for b in range(a) if a % 3 and b % 3 and near(a, b)])
        lists = [(h, i, p, len(sets[i]), roots[i]) for h, p in ((1, 1), (2, 2), (3, 3)) for i in range(size)]
        open_ = spark.createDataFrame(lists, "h long, sk long, p long, n long, root long")
        frame = spark.createDataFrame([(i, len(x), x) for i, x in enumerate(sets)], "sk long, n long, s array<long>")
        run = lambda: similar_sets.similar(similar_sets.stash(similar_sets.all_open(open_, frame, 4, 5), "test-met"), frame, 4, 5).collect()  # noqa: B023, E731
        got, rows = join_rows(spark, run)
        want = classes(size, [(a, b) for a in range(size) for b in range(a) if near(a, b)])
        links = [(r.a, r.b) for r in got] + [(i, r) for i, r in enumerate(roots) if i != r]
        assert classes(size, links) == want and len(set(want)) < len(set(roots))
        made.append(rows)
    assert made[1] < 3 * made[0], made
