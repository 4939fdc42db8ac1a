"""Token counts by a compiled finite-state transducer for piece (BPE) vocabularies with byte fallback.

The transducer reads characters; each transition carries the change of the emitted-token count. Its states are
finite: BPE's last token is fixed by the tokens that could end where it starts, and no token is longer than the
vocabulary's longest piece, so a state holds, for each start a longer piece could still have, the characters
since, the token before, and the count relative to here. States and transitions are built when first met and the
table is flushed when it is full, so memory is bounded.

A long text is cut into chunks, and a chunk is a map from entry state to exit state and count. It is kept as the run
from the start state: from any other entry state the two runs soon meet, and from there on counts and exit are known.
Maps compose associatively and are reduced by a tree of pairs, the levels of a prefix scan. Spaces start pieces and
never stand within them, so a space after another character leads to the same state from everywhere; between such
places words are counted one by one and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import operator

SPACE = "▁"
CHUNK, MAX_STATES, MAX_PAIRS, MAX_WORDS, WORD_CHARS = 1 << 16, 400_000, 600_000, 300_000, 48
START = (("", None, 0),)


class Vocabulary:
    """Pieces with their scores, and whether a blank goes before the text; built from a .model file."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not odd(i)})


class Words(dict):
    """Counts by word, filled on demand and flushed when full."""

    def __init__(self, machine: Transducer, prefix: str):
        self.machine, self.prefix = machine, prefix

    def __missing__(self, word: str) -> int:
        text, inside = self.prefix + word, self.machine.inside
        if len(word) > WORD_CHARS:
            return self.machine.run(text)
        at = next((i for i in range(len(text) - 1, len(self.prefix), -1) if text[i - 1 : i + 1] not in inside), 0)
        if at:  # no piece spans this place
            n = self[word[: at - len(self.prefix)]] + self.machine.bare[text[at:]]
        else:
            n = self.machine.run(text)
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = n
        return n


class Transducer:
    def __init__(self, vocab: Vocabulary):
        self.pieces = vocab.pieces
        self.alive = {p[:i] for p in self.pieces for i in range(1, len(p))}
        #: Neighbours within some piece. Between any others the text falls apart.
        self.inside = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        order = sorted(self.pieces, key=lambda p: -self.pieces[p])
        #: When a piece is formed: characters first, then by score. Runs of blanks share scores, see `fits`.
        self.rank = {p: i if len(p) > 1 else -1 for i, p in enumerate(order)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.spaced, self.bare = Words(self, SPACE), Words(self, "")
        self.reset()

    def reset(self) -> None:
        """Flush the table. A row maps characters to (next row, change of the count), None to its state."""
        self.rows: dict[tuple, dict] = {START: {None: START}}

    def row(self, state: tuple) -> dict:
        if (row := self.rows.get(state)) is None:
            if len(self.rows) >= MAX_STATES:
                self.reset()
            row = self.rows[state] = {None: state}
        return row

    def merge(self, parts: list[str], times: int = -1) -> list[str]:
        """BPE by definition: join the best-scored adjacent pair, the leftmost of equals, until none is a piece."""
        parts, pieces = list(parts), self.pieces
        while times:
            times -= 1
            best = max(((pieces[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in pieces), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, token: str) -> tuple[str, str] | None:
        """The two parts whose merge forms this piece last; empty strings for a character, None if BPE never forms it."""
        if token not in self.splits:
            parts, was = [*token], [token, ""]
            while len(parts) > 1:
                was, n = parts, len(parts)
                parts = self.merge(parts, 1)
                if len(parts) == n:
                    break
            self.splits[token] = None if len(parts) > 1 else ("", "") if len(token) == 1 else (was[0], was[1])
        return self.splits[token]

    def fits(self, before: str | None, token: str) -> bool:
        """Whether BPE leaves these two tokens side by side.

        Their merges are undone from the latest to the first. If the pieces that then meet at the border could
        have merged before the one undone last was formed, BPE would have merged them.
        """
        key = (before, token)
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._fits(before, token)
        return ok

    def _fits(self, a: str | None, b: str) -> bool:
        if self.split(b) is None:
            return False
        if a is None:
            return True
        if SPACE * 2 in a + b:  # equal scores: by definition
            return self.merge([*a, *b]) == [a, b]
        rank, limit = self.rank, len(self.rank) + 1
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.split(a)[1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.split(b)[0]
            else:
                return True

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """The transition: next state and change of the count."""
        if char not in self.pieces:
            return START, len(char.encode())  # byte fallback; nothing joins across it
        pieces, alive, open_ = self.pieces, self.alive, []
        token = None
        for since, before, n in state:
            now = since + char
            if token is None and now in pieces and self.fits(before, now):
                token, count = now, n + 1
            if now in alive:
                if before and before[-1] + now[0] not in self.inside:
                    before = None
                open_.append((now, before, n))
        return (*[(now, before, n - count) for now, before, n in open_], ("", token, 0)), count

    def run(self, text: str) -> int:
        """Tokens of a text whose blanks are pieces' marks already, read from the start state."""
        total, row = 0, self.rows[START]
        for char in text:
            arc = row.get(char)
            if arc is None:
                state, n = self.step(row[None], char)
                arc = row[char] = self.row(state), n
            row, n = arc
            total += n
        return total

    def body(self, text: str) -> int:
        """Tokens of a text that begins at a boundary and ends at one."""
        total = 0
        for i, line in enumerate([text] if "\n" in self.pieces else text.split("\n")):
            total += i > 0  # the line feed's byte, which nothing joins across
            first, *words = line.split(" ")
            if "" not in words:
                total += (self.bare[first] if first else 0) + sum(map(self.spaced.__getitem__, words))
                continue
            for part in re.findall(r" *[^ ]+| +", line):
                if part[:2] == "  ":
                    total += self.run(part.replace(" ", SPACE))
                else:
                    total += self.spaced[part[1:]] if part[0] == " " else self.bare[part]
        return total

    def trace(self, text: str) -> tuple[list[tuple], list[int]]:
        """The states after each character, from the start state, and the tokens so far."""
        states, counts, total, row = [], [], 0, self.rows[START]
        for char in text:
            row, n = self.next(row, char)
            total += n
            states.append(row[None])
            counts.append(total)
        return states, counts

    def next(self, row: dict, char: str) -> tuple[dict, int]:
        if (arc := row.get(char)) is None:
            state, n = self.step(row[None], char)
            arc = row[char] = self.row(state), n
        return arc

    def count(self, text: str) -> int:
        """Tokens of the whole text, with the blank that the library puts before it."""
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")
        if len(text) <= CHUNK:
            return self.body(text)
        maps = [ChunkMap(self, text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # a level of the scan's tree
            maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0].total


class ChunkMap:
    """Entry state -> (exit state, tokens) of a chunk. total and exit are those of the start state."""

    def __init__(self, machine: Transducer, chunk: str):
        self.machine = machine
        first = re.search(r"[^ ] ", chunk)
        i = first.start() + 1 if first else len(chunk)
        self.head = chunk[:i].replace(" ", SPACE)
        self.states, self.counts = machine.trace(self.head)
        self.fixed, self.exit = 0, self.states[-1]
        if first:  # from here on all entry states lead to the same
            j = chunk.rfind(" ")
            while chunk[j - 1] == " ":
                j -= 1
            states, counts = machine.trace(chunk[j:].replace(" ", SPACE))
            self.fixed, self.exit = machine.body(chunk[i:j]) + counts[-1], states[-1]
        self.resets = bool(first)
        self.total = self.counts[-1] + self.fixed

    def apply(self, state: tuple) -> tuple[tuple, int]:
        row, total = self.machine.row(state), 0
        was, counted = START, 0
        for char, now, upto in zip(self.head, self.states, self.counts, strict=True):
            if row[None] == was:  # the runs meet
                return self.exit, total + self.total - counted
            row, n = self.machine.next(row, char)
            total, was, counted = total + n, now, upto
        return (self.exit, total + self.fixed) if self.resets or row[None] == was else (row[None], total)


class Composed:
    """The map of a and then b."""

    def __init__(self, a: ChunkMap | Composed, b: ChunkMap | Composed):
        self.a, self.b = a, b
        self.exit, n = b.apply(a.exit)
        self.total = a.total + n

    def apply(self, state: tuple) -> tuple[tuple, int]:
        middle, n = self.a.apply(state)
        if middle == self.a.exit:
            return self.exit, n + self.total - self.a.total
        end, m = self.b.apply(middle)
        return end, n + m


_MACHINES: dict[int, Transducer] = {}


@operator
def count_tokens(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty (0 bytes, 0 tokens). Every row is counted by itself, so repeated rows repeat;
    long texts are read in chunks. An empty table gives an empty result; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary.pieces)  # the size of the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held.value
        if (key := hash(frozenset(pieces.items()))) not in _MACHINES:
            _MACHINES.clear()
            _MACHINES[key] = Transducer(Vocabulary(pieces))
        count = _MACHINES[key].count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([count(t.as_py()) for t in b.column(2)], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
