"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only. Blocks are 64 words long and start every 32 words. A block meets a template if it holds
at least a given share of the template's distinct words. The join is exact: the template words are ordered by their
frequency in the corpus, rarest first; a match must share a word among the first |x| - a + 1 words of the block and
|y| - a + 1 of the template (prefix filter, a: the words needed), the block needs a template words (length filter), and
the places of the shared word in both orders bound the overlap (positional filter). What passes is verified.

The corpus is read once. Words are counted by an expression, and split only where a text can hold a phrase or a
template at all: it must contain all words of the phrase, or one of any y - a + 1 words of the template, as parts of
its letters. This test loses nothing; what it lets through is decided by words.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import lower_ascii, operator, stash

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same runs before A-Z are lower-cased.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK, STRIDE = 64, 32

#: Exact phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The wording of well-known notices, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "you may not use this file except in compliance with the license": "apache",
    "free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by nc": "cc",
    "this work is licensed under a creative commons attribution license": "cc",
    "all rights reserved": "reserved",
    "dedicated to the public domain": "public-domain",
}


def terms(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def term_count(text: Column) -> Column:
    """The number of terms, without making them."""
    return F.coalesce(F.regexp_count(text, F.lit(ANY_CASE)), F.lit(0)).cast("long")


def may_hold(text: Column, phrases: list[list[str]], sets: list[list[str]], need: list[int]) -> Column:
    """Whether the letters of the text allow for a phrase or a template. lower() also lowers other letters, so it only adds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    every = [reduce(lambda a, b: a & b, [low.contains(w) for w in sorted(p, key=len, reverse=True)]) for p in phrases]
    # The longest words, as they are the rarest.
    some = sorted({w for s, a in zip(sets, need, strict=True) for w in sorted(s, key=lambda w: (-len(w), w))[: len(s) - a + 1]})
    return reduce(lambda a, b: a | b, [*every, *[low.contains(w) for w in some]], F.lit(False))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def phrase_places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, from 0."""
    want = phrase.split()
    n = F.size(words)
    at = lambda i: reduce(lambda a, b: a & b, [F.element_at(words, i + k + 1) == w for k, w in enumerate(want)])
    found = F.filter(F.sequence(F.lit(0), n - len(want)), at)
    return F.when((n >= len(want)) & F.array_contains(words, want[0]), found).otherwise(F.array().cast("array<int>"))


def _order(rows: DataFrame, known: list[str]) -> dict[str, int]:
    """Ranks of the template words by the number of rows that hold them, rarest first; a row for each template word.

    Rows that cannot meet any template have no words here and no part in the join.
    """
    held = rows.select(F.explode(F.array_intersect("words", _strings(known))).alias("term")).groupBy("term").count()
    count = {r["term"]: r["count"] for r in held.collect()}
    return {w: i for i, w in enumerate(sorted(known, key=lambda w: (count.get(w, 0), w)))}


@operator
def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    n_base counts the phrases' places, first_word and last_word are the least and greatest start (null without any).
    labels adds those of templates that a block holds to the threshold; matches lists them (label, block, share).
    score: 1 with a phrase, else the best share found, 0 without any. Null and empty texts have no words, no labels
    and score 0. Repeated rows repeat. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    named = list(templates.items())
    sets = [sorted(set(t.split())) for t, _ in named]
    known = sorted(set().union(*sets)) if sets else []
    need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), term_count(text).alias("n_words"), F.when(may_hold(text, [p.split() for p in phrases], sets, need), text).alias("_text"))
    rows = rows.select("id", "n_words", terms(F.col("_text")).alias("words"))
    base = rows.select("id", "n_words", "words", *[phrase_places(F.col("words"), p).alias(f"p{i}") for i, p in enumerate(phrases)])
    places = F.concat(*[f"p{i}" for i in range(len(phrases))]) if phrases else F.array().cast("array<int>")
    labels = F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(v)) for i, v in enumerate(phrases.values())]) if phrases else F.array().cast("array<string>"), lambda x: x.isNotNull())
    # A text that holds too few of a template's words has no block that holds enough.
    enough = reduce(lambda a, b: a | b, [F.size(F.array_intersect("words", _strings(s))) >= a for s, a in zip(sets, need, strict=True)], F.lit(False))
    base = base.select(
        F.monotonically_increasing_id().alias("row"), "id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), labels.alias("base"),
        F.when(enough, F.col("words")).alias("words"),
    )
    base = stash(base, "licenses")  # fixes the row numbers; keeps the words of candidates only

    rank = _order(base, known) if known else {}
    ordered = [sorted(s, key=rank.__getitem__) for s in sets]
    prefixes = [s[: len(s) - a + 1] for s, a in zip(ordered, need, strict=True)]
    rare = sorted(set().union(*prefixes)) if prefixes else []
    entries = [(i, named[i][1], w, j + 1, len(ordered[i]), need[i]) for i in range(len(named)) for j, w in enumerate(prefixes[i])]
    index = spark.createDataFrame(entries, "template int, label string, term string, j int, y int, a int")
    whole = spark.createDataFrame([(i, s) for i, s in enumerate(ordered)], "template int, terms array<string>")
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / STRIDE).cast("int"))
    blocks = base.filter("size(words) > 0").select("row", "words", F.explode(starts).alias("block"))
    blocks = blocks.select("row", "block", F.slice("words", F.col("block") * STRIDE + 1, BLOCK).alias("w"))
    in_order = F.array_intersect(_strings(sorted(known, key=rank.__getitem__)), F.col("w"))  # keeps the global order
    blocks = blocks.filter(F.arrays_overlap("w", _strings(rare))).select("row", "block", in_order.alias("x"))
    posted = blocks.select("row", "block", "x", F.posexplode("x").alias("i", "term")).join(F.broadcast(index), "term")  # as long as the template list
    size, i, j = F.size("x"), F.col("i") + 1, F.col("j")
    posted = posted.filter((size >= F.col("a")) & (i <= size - F.col("a") + 1) & (1 + F.least(size - i, F.col("y") - j) >= F.col("a")))
    pairs = posted.select("row", "block", "x", "template", "label", "y", "a").distinct().join(F.broadcast(whole), "template")
    share = F.size(F.array_intersect("x", "terms"))
    met = pairs.withColumn("shared", share).filter(F.col("shared") >= F.col("a"))
    per_row = met.groupBy("row").agg(
        F.max(F.col("shared") / F.col("y")).alias("best"),
        F.collect_set("label").alias("more"),
        F.array_sort(F.collect_set(F.struct("label", "block", (F.col("shared") / F.col("y")).alias("share")))).alias("matches"),
    )
    out = base.drop("words").join(per_row, "row", "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", _joined(F.col("base")).alias("base_labels"), _joined(F.concat("base", more)).alias("labels"), score.alias("score"), "matches")


def oracle_sql(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> str:
    """The same by brute force in DuckDB: every block against every template."""
    lists = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    t = ", ".join(f"({lists(sorted(set(k.split())))}, '{v}')" for k, v in templates.items())
    p = ", ".join(f"({lists(k.split())}, '{v}')" for k, v in phrases.items())
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p(phrase, label) AS (VALUES {p}),
t(terms, label) AS (VALUES {t}),
h AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(phrase) + 1), lambda i: w[i + 1 : i + len(phrase)] = phrase)) AS pos
  FROM d, p WHERE list_has_all(w, phrase)),
hb AS (
  SELECT doc_id, count(*)::BIGINT AS n_base, min(pos)::BIGINT AS first_word, max(pos)::BIGINT AS last_word, list(DISTINCT label) AS labels
  FROM h GROUP BY doc_id),
b AS (SELECT doc_id, unnest(list_transform(range(0, (len(w) + {STRIDE - 1}) // {STRIDE}), lambda k: w[k * {STRIDE} + 1 : k * {STRIDE} + {BLOCK}])) AS x FROM d),
m AS (SELECT doc_id, label, len(list_intersect(terms, x)) / len(terms) AS share FROM b, t WHERE len(list_intersect(terms, x)) >= ceil({threshold} * len(terms) - 1e-9)),
mb AS (SELECT doc_id, max(share) AS best, list(DISTINCT label) AS labels FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(hb.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(hb.labels, []), coalesce(mb.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN hb USING (doc_id) LEFT JOIN mb USING (doc_id)
"""
