"""Token counts by a finite-state tokenizer, compiled from a byte-fallback BPE model.

The model's merges have a unique left-to-right reading: a text's last token is
the one piece that ends there, is stable by itself and is stable next to the last
token of the text before it.  So the state after a prefix needs only the places
from which a piece can still grow (suffixes that begin some piece), with the last
token and the count there, relative to the count so far.  Such states are few and
repeat; transitions (state, character) carry the change of the token count.  They
are compiled when first met and kept, at most ``KEPT`` of them.

A text is cut into chunks of ``CHUNK_CHARS`` characters.  A chunk's state map takes
any state to an end state and a count: up to its first word start it depends on
what comes before, from there on on nothing.  Maps compose associatively, and a
prefix scan over the chunks (log2 rounds of pairwise composition) gives the count
up to every chunk's end, so the state runs on across chunk borders.

Counting is one pass without a shuffle.  Words that repeat are counted once per
task, at most ``KEPT`` of them at a time.  The model file's path is a parameter.

Edge cases: null and empty texts have no bytes and no tokens; characters without a
piece count one token per byte; strings that look like special tokens are plain
text; null ids pass through; an empty table returns none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from slotwise.llm.common import prepare
from slotwise.llm.piece_nbest import SPACE, UNIT, read_model

CHUNK_CHARS = 1 << 15
KEPT = 500_000
#: Where a word starts inside a chunk: spaces after another character.
START = re.compile(f"(?<=[^{SPACE}]){SPACE}")
_NO_TOKEN = ""


class Transducer:
    """States and transitions of one model; state 0 is the start of a word."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i)
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} crosses a space")
                self.score[piece] = sp.get_score(i)
        self.begins = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A state lists (open suffix, last token before it, its count less the count so far), longest first.
        start = (("", _NO_TOKEN, 0),)
        self.states, self.numbers = [start], {start: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}

    def merge(self, text: str) -> list[str]:
        """The model's own merging: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, left: str, right: str) -> bool:
        """Whether two tokens stay as they are next to each other (``left`` empty: one token by itself)."""
        key = (left, right)
        if key not in self._pairs:
            if len(self._pairs) > KEPT:
                self._pairs.clear()
            self._pairs[key] = self.merge(left + right) == ([left, right] if left else [right])
        return self._pairs[key]

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        grown = [(suffix + char, last, count) for suffix, last, count in self.states[state]]
        if char not in self.score:
            change = len(char.encode())  # byte pieces, which never merge
            return self._number((("", _NO_TOKEN, 0),)), change
        for suffix, last, count in grown:
            if suffix in self.score and self.stable("", suffix) and (not last or self.stable(last, suffix)):
                token, change = suffix, count + 1
                break
        else:
            raise ValueError(f"no token ends at {grown!r}")
        rest = [(suffix, last, count - change) for suffix, last, count in grown if suffix in self.begins]
        return self._number((*rest, ("", token, 0))), change

    def _number(self, key: tuple) -> int:
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        return number

    def run(self, state: int, text: str) -> tuple[int, int]:
        """State and change of the count after ``text``."""
        total, moves = 0, self.moves
        for char in text:
            move = moves.get((state, char))
            if move is None:
                move = moves[state, char] = self._compile(state, char)
            state, change = move
            total += change
        return state, total


class Counter(dict):
    """Tokens of whole words, each run through the transducer once."""

    def __init__(self, model: bytes) -> None:
        super().__init__()
        self.machine = Transducer(model)

    def __missing__(self, word: str) -> int:
        self[word] = count = self.machine.run(0, word)[1]
        return count

    def trim(self) -> None:
        """Forget words and transitions when there are many; state numbers are valid between two calls only."""
        if len(self) > KEPT:
            self.clear()
        if len(self.machine.moves) > KEPT:
            self.machine._reset()

    def chunk_map(self, chunk: str) -> tuple[str, int, int | None]:
        """State map of a chunk: the part that depends on the state before, the count after it, the end state.

        The end state is None if no word starts inside the chunk.
        """
        first = START.search(chunk)
        if first is None:
            return chunk, 0, None
        words = UNIT.findall(chunk, first.start())
        state, count = self.machine.run(0, words[-1])
        return chunk[: first.start()], count + sum(map(self.__getitem__, words[:-1])), state

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two chunks in a row."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, count = self.machine.run(a[2], b[0])
        return a[0], a[1] + count + b[1], state if b[2] is None else b[2]

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Composition of the maps up to each chunk, in log2 rounds."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def chunk_ends(self, text: str, size: int = CHUNK_CHARS) -> list[int]:
        """Tokens of a text up to the end of each of its chunks."""
        if not text:
            return []
        seen = SPACE + text.replace(" ", SPACE)
        bounds = [0]
        while bounds[-1] < len(seen):
            # A word start lies inside a chunk only with the character before it, and spaces stay together.
            end = min(len(seen), bounds[-1] + size)
            while end < len(seen) and (seen[end] == SPACE or seen[end - 1] == SPACE):
                end += 1
            bounds.append(end)
        maps = self.scan([self.chunk_map(seen[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        return [count + self.machine.run(0, head)[1] for head, count, _ in maps]

    def count(self, text: str, size: int = CHUNK_CHARS) -> int:
        if len(text) <= size:
            return sum(map(self.__getitem__, UNIT.findall(SPACE + text.replace(" ", SPACE)))) if text else 0
        return self.chunk_ends(text, size)[-1]


_COUNTERS: dict[bytes, Counter] = {}


def _counter(model: bytes) -> Counter:
    if model not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[model] = Counter(model)
    return _COUNTERS[model]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model.value)
        try:
            for batch in batches:
                sizes, counts = [], []
                for text in batch.column(text_col).to_pylist():
                    counter.trim()
                    sizes.append(len((text or "").encode()))
                    counts.append(counter.count(text or ""))
                made = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *made], [id_col, "n_bytes", "n_tokens", "over_limit"])
        finally:
            counter.clear()  # an idle worker keeps no words; the transitions stay, up to their bound

    slim = docs.select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
