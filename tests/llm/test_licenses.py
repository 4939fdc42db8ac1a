import re

import pytest

from cairn.llm import licenses, queries
from tests.llm.data import docs, rows
from tests.oracle import compare


def brute(text, phrases=licenses.PHRASES, templates=licenses.TEMPLATES, threshold=0.8):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(licenses.TERM, low)
    places, base = [], set()
    for p, label in phrases.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    best, more = 0.0, set()
    for k in range(0, max(len(w), 0), licenses.STRIDE):
        block = set(w[k : k + licenses.BLOCK])
        for t, label in templates.items():
            t = set(t.split())
            share = len(t & block) / len(t)
            if share >= threshold - 1e-12:
                more.add(label)
                best = max(best, share)
    score = 1.0 if places else best
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), pytest.approx(score)


TEXTS = [
    "Released under the MIT License. mit license", "licensed under cc by nc 4.0", "All rights\nreserved", "all rights", "Permission is hereby granted, free of charge, to any person obtaining a copy of this Software",
    "x " * 40 + "permission is hereby granted free of charge to any person obtaining " + "y " * 90, "general public license" * 2, "GENERAL PUBLIC\tLICENSE general public license", "mit mit license license apache license",
]


def test_against_plain_python(spark):
    data = rows(n=100) + [(1000 + i, t, None, None, 0) for i, t in enumerate(TEXTS)]
    got = licenses.scan(docs(spark, data)).collect()
    assert len(got) == len(data)
    by = {i: t for i, t, *_ in data}
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(by[r.doc_id]), by[r.doc_id]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_filters_lose_no_match(spark, threshold):
    """Common words in the templates, low thresholds: every block that brute force finds."""
    templates = {"the and of with": "t1", "the license apache 1234 und": "t2", "avec été für": "t3"}
    data = rows(seed=5, n=150)
    got = licenses.scan(docs(spark, data), templates=templates, threshold=threshold).collect()
    by = {i: t for i, t, *_ in data}
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(by[r.doc_id], templates=templates, threshold=threshold)


def test_empty_table_and_lists(spark):
    assert licenses.scan(docs(spark, [])).count() == 0
    got = licenses.scan(docs(spark, [(1, "mit license", None, None, 0)]), templates={}).collect()
    assert (got[0].labels, got[0].score, got[0].matches) == ("mit", 1.0, None)


def test_sql(spark):
    assert compare(spark, queries.op5_licenses, queries.oracle_sql()["op5_licenses"], "/root/testdata/sf0.001") == 200
