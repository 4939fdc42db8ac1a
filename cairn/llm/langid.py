"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the number of n-grams (1 to 3 UTF-8 bytes, hashed) that both contain, divided by the
geometric mean of their own numbers. Nyström landmarks turn it into features; one-versus-rest kernel ridge
regression on them is solved in closed form, and folded into one matrix, so a batch is scored by two matrix products:
presence x landmarks, kernel x coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import crc_mod3, gives_back, operator
from cairn.llm.mixing import HASH_BITS, hash60

GRAMS, DIM, BATCH, PART = (1, 2, 3), 1 << 13, 64, 1 << 20
LETTER = r"\p{L}"


def presence(text: str, out: np.ndarray) -> None:
    """Mark in `out` (one row, zeros) which hashed n-grams the whole text has."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    for at in range(0, max(1, len(raw)), PART):
        b = raw[at : at + PART + max(GRAMS) - 1].astype(np.uint64)
        code = b
        for n in GRAMS:
            if n > 1:
                code = code[:-1] << np.uint64(8) | b[n - 1 :]
            if len(code):
                out[((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 13)).astype(np.int64)] = 1


def presences(texts: list[str]) -> np.ndarray:
    """Unit rows: presence divided by the root of its count, so that products are normalised kernels."""
    x = np.zeros((len(texts), DIM), np.float32)
    for row, text in zip(x, texts, strict=True):
        presence(text, row)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # DIM x m
    coefficients: np.ndarray  # m x languages
    sharpness: float = 10.0

    def scores(self, texts: list[str]) -> np.ndarray:
        f = self.sharpness * (presences(texts) @ self.landmarks @ self.coefficients)
        e = np.exp(f - f.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], *, landmarks: int = 160, ridge: float = 1e-2) -> Model:
    """Landmarks are dealt evenly to the languages in the given order of rows."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros((0, 0), np.float32))
    of = np.array([names.index(x) for x in langs])
    x = presences(texts)
    share = max(1, landmarks // len(names))
    at = np.concatenate([np.flatnonzero(of == k)[:share] for k in range(len(names))])
    marks = x[at]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    z = (x @ marks.T).astype(np.float64) @ whiten
    y = (of[:, None] == np.arange(len(names))).astype(np.float64)
    weight = (1 / np.bincount(of))[of][:, None] * len(of) / len(names)  # rare languages count as much as common ones
    solved = np.linalg.solve((z * weight).T @ z + ridge * len(of) / 100 * np.eye(z.shape[1]), (z * weight).T @ y)
    return Model(names, np.ascontiguousarray(marks.T), (whiten @ solved).astype(np.float32))


def sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_language: int, max_languages: int, max_bytes: int) -> tuple[list[str], list[str]]:
    """About `per_language` texts of each language, those with the smallest id hashes; the bound on what is fitted."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER) & (F.octet_length(text_col) <= max_bytes))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return [], []
    near: Column = F.lit(False)
    for r in counts:
        near = near | ((F.col(lang_col) == r["lang"]) & (hash60(F.col(id_col)) < int(min(1.0, per_language / r["count"]) * (1 << HASH_BITS))))
    # In order, so that the bound cuts the same rows each time.
    got = rows.filter(near).select(F.col(lang_col).alias("_l"), F.col(text_col).alias("_t"), hash60(F.col(id_col)).alias("_h")).orderBy("_h", "_t", "_l").limit(2 * per_language * len(counts)).collect()
    return [r["_t"] for r in got], [r["_l"] for r in got]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, max_languages: int = 200, max_bytes: int = 1 << 16) -> Model:
    """Fit on a bounded sample of the rows given (at most 2 x per_language x max_languages texts of at most max_bytes).

    Only the max_languages most frequent labels are learnt; rarer ones are never predicted.
    """
    return fit(*sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, per_language=per_language, max_languages=max_languages, max_bytes=max_bytes))


def _scored(docs: DataFrame, model: Model, names: list[str], text_col: str) -> DataFrame:
    """The named columns, the predicted language and its score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIM x landmarks floats: of fixed size
    width, own = len(names), names.index(text_col) if text_col in names else len(names) + 1

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            known, texts = b.column(width).to_pylist(), b.column(own)
            at = [i for i, ok in enumerate(known) if ok and m.langs]
            langs, score = ["und"] * len(b), np.zeros(len(b))
            for i in range(0, len(at), BATCH):
                part = at[i : i + BATCH]
                s = m.scores([texts[j].as_py() for j in part])
                for j, k, v in zip(part, s.argmax(axis=1), s.max(axis=1), strict=True):
                    langs[j], score[j] = m.langs[k], min(1.0, float(v))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(langs), pa.array(score)], names=[*names, "_cairn_lang", "_cairn_score"])

    text = [] if text_col in names else [F.col(text_col).alias("_cairn_text")]  # sent once
    rows = docs.select(*names, F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False)).alias("_cairn_known"), *text)
    schema = docs.select(*names).withColumns({"_cairn_lang": F.lit("").cast("string"), "_cairn_score": F.lit(0.0)}).schema
    return rows.mapInArrow(run, schema)


@operator
def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (share of the chosen language, 0 to 1) of every whole text.

    Texts that are null or have no letter get `und` with score 0, as does everything if the model knows no language.
    Ties go to the language first in order. Repeated rows repeat; other columns are not read.
    """
    out = _scored(docs, model, [id_col], text_col)
    return out.select(id_col, F.col("_cairn_lang").alias("lang_pred"), F.col("_cairn_score").alias("score"))


def keep_known(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows whose language can be told, with all their columns, whatever these are called.

    If the model knows no language (no row had a label), all rows with a letter stay.
    """
    if not model.langs:
        return docs.filter(F.col(text_col).rlike(LETTER))
    return _scored(docs, model, docs.columns, text_col).filter("_cairn_lang <> 'und'").select(docs.columns)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """Train on the rows outside the held-out third (crc32 of the id, mod 3, is 1) and predict all: id, held_out, lang_pred, score."""
    model = train(docs.filter(crc_mod3(F.col(id_col)) != 1), id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    out = predict(docs, model, id_col=id_col, text_col=text_col)
    return out.select(id_col, (crc_mod3(F.col(id_col)) == 1).alias("held_out"), "lang_pred", "score")
