from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F

from cairn.llm.common import stash
from tests.llm.data import docs, rows
from tests.llm.test_simhash import brute_fingerprint, classes


def test_stages_against_plain_python(spark):
    data = [r for r in rows(n=160) if r[0] is not None]
    cur = docs(spark, data)
    columns = cur.columns
    seen = []
    for _, stage in cp.STAGES:
        cur = stash(stage(spark, cur, ""), "test-stage")
        seen.append(cur)
    lang, exact, near, mix, packed = seen
    for df in seen[:-1]:
        assert df.columns == columns
    has_letter = lambda t: any(c.isalpha() for c in t or "")
    assert Counter(r.doc_id for r in lang.collect()) == Counter(r[0] for r in data if has_letter(r[1]))
    last = {}
    for r in lang.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert Counter(r.doc_id for r in exact.collect()) == Counter(last.values())
    text = {r.doc_id: r.text for r in exact.collect()}
    ids = sorted(text)
    fp = [brute_fingerprint(text[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3]
    assert Counter(r.doc_id for r in near.collect()) == Counter({ids[r] for r in classes(len(ids), links)})
    taken = Counter(r.doc_id for r in mix.collect())
    assert set(taken) <= {r.doc_id for r in near.collect()} and max(taken.values()) <= 3
    words = {i: len(text[i].encode().split()) for i in text}
    got = Counter()
    for r in packed.collect():
        got[r.doc_id] += r.size
    assert got == Counter({i: n * words[i] for i, n in taken.items()})


def test_empty_documents(spark):
    cur = docs(spark, [], clash=False)
    for _, stage in cp.STAGES:
        cur = stash(stage(spark, cur, ""), "test-stage")
    assert cur.count() == 0


def test_run_on_the_smallest_tables(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    per_bin = out.groupBy("bin_id").agg(F.sum("size").alias("n"))
    assert out.count() > 0 and per_bin.filter("n > 2048").count() == 0
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
