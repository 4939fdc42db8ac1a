import random

import public_tokenizers
import pytest
import sentencepiece

from cairn.llm import token_count as tc
from tests.llm.data import docs, rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABETS = ["a b  c the\n\tthe of 1234 ", "▁▁ ab", "日本語 中文字 é ß😀 ", "   \n  x", "aaaa bbb", "<s></s><unk><0x0A> ", "inthe.,;: reading)("]


@pytest.fixture(scope="module")
def machine():
    return tc.Transducer(tc.Vocabulary.load(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("chunk", [3, 17, 1 << 16])
def test_counts_equal_the_library(machine, library, chunk, monkeypatch):
    monkeypatch.setattr(tc, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(1500):
        source = rng.choice(ALPHABETS) + rng.choice(ALPHABETS)
        text = "".join(rng.choice(source) for _ in range(rng.randint(0, 80)))
        assert machine.count(text) == len(library.encode(text)), repr(text)
    for n in range(70):
        for word in ("", "x", "\nthe "):
            assert machine.count(" " * n + word) == len(library.encode(" " * n + word))


@pytest.mark.parametrize("text", [" " + "ab the  in\nx" * 9, " " + "日本語中文字" * 30, " " + "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 12, " " + "aaaaaaaa" * 20, " " * 90, " \n" * 30])
@pytest.mark.parametrize("size", [1, 7, 16])
def test_maps_compose(machine, text, size):
    """Also without blanks: chunks are counted each by itself, in any order of composing, from any entry state."""
    maps = [tc.ChunkMap(machine, text[i : i + size]) for i in range(0, len(text), size)]
    left = maps[0]
    for m in maps[1:]:
        left = tc.Composed(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = tc.Composed(m, right)
    marked = text.replace(" ", tc.SPACE)
    assert left.total == right.total == machine.run(marked) == machine.count(text[1:])
    for entry in (tc.START, *machine.trace("▁the▁inter")[0], *machine.trace("aaa日本")[0]):
        row, n = machine.row(entry), 0
        for char in marked:
            row, k = machine.next(row, char)
            n += k
        assert left.apply(entry) == right.apply(entry) == (row[None], n)


def test_flushed_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tc, "MAX_STATES", 50)
    monkeypatch.setattr(tc, "MAX_WORDS", 20)
    m = tc.Transducer(tc.Vocabulary.load(PATH))
    text = " ".join("".join(random.Random(i).choices("etaoinshrdlu.,", k=9)) for i in range(400))
    assert m.count(text) == len(library.encode(text))


def test_awkward_rows(spark, library):
    data = rows()
    got = tc.count_tokens(docs(spark, data), tc.Vocabulary.load(PATH), limit=40).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    for i, text, *_ in data:
        n = len(library.encode(text or ""))
        assert (by[i].n_bytes, by[i].n_tokens, by[i].over_limit) == (len((text or "").encode()), n, n > 40)
    assert tc.count_tokens(docs(spark, []), tc.Vocabulary.load(PATH)).count() == 0
