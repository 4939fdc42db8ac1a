"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

CLASHES = ["id", "key", "digest", "h", "n", "size", "fp", "root", "row", "words", "cluster", "piece", "_id", "_s", "shard", "target", "lang_pred", "score"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "and", "idiot", "MIT", "License", "Avec", "été", "für", "straße", "日本語", "apache", "license", " x", "a b", "1234", "x" * 70, "<s>", "▁▁"]


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out = [(0, None, "en", "a", 0), (1, "", None, "a", 0), (2, " \t\n ", "de", None, 4), (3, "!!! 123", "fr", "b", 7), (4, "One", "en", "b", 3), (5, "two words", "en", None, 9)]
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    out += [(6, long, "en", "big", len(long)), (7, long, "en", "big", len(long)), (8, "z" * 100_000, "en", "big", 100_000)]
    for i in range(9, n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80)))
        if i % 4 == 0:
            text = out[-1][1] or ""
        out.append((i, text, rng.choice(["en", "fr", "de", None]), rng.choice(["a", "b", "c", "", None, "é"]), len(text)))
    return out + [out[4], out[4], out[12]]  # whole rows that repeat


def docs(spark, data=None, clash: bool = True, schema: str = SCHEMA):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, schema)
    return df.withColumns({c: F.lit(f"clash-{c}") for c in CLASHES if c not in df.columns}) if clash else df
