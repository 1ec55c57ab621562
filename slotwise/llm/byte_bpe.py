"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by the vocabulary's pattern and every match is encoded by itself.  A
match that is a token is that token.  Otherwise each of its bytes starts as a token,
and the pair of the lowest rank, the leftmost of equals, is merged until no pair has
a rank.

The pair that starts at a byte position is a leaf of a segment tree, with the key
``rank * width + position``; each inner node holds the smaller key of its two, so the
root names the leftmost pair of the lowest rank.  Live neighbours are linked by
position.  A merge changes three leaves: the pair that starts at the merged token, the
pair of its live neighbour to the left, and the pair of the absorbed neighbour, which
goes.  Each is a point update of logarithmic cost, so a match of n bytes takes
O(n log n), however long.

Encoding and decoding are passes without a shuffle.  A task encodes a match that
repeats once, and keeps about ``KEPT`` of them.  The trees of new short matches are rows of
one matrix, and a step merges a pair in every row that has one.  The rank file's path is a
parameter; its vocabulary, a fixed file, is what is broadcast.

Edge cases: null and empty texts have no ids; text that looks like a special token is
plain text; null ids decode to no bytes, ids outside the vocabulary raise; the decoded
value is binary, as ids need not end at a character; repeated rows and null document
ids pass through row by row; an empty table returns none.  Columns asked for by
``keep`` pass through whatever their names, except for those of the results.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import prepare
from slotwise.llm.piece_nbest import read_model, text_parts

#: Matches, and ids of them, beyond which a task forgets those that it met.
KEPT, KEPT_IDS = 500_000, 4_000_000
#: Longest matches whose trees are merged together, and how many at once.
FOREST_BYTES, FOREST_ROWS = 64, 4096
_NONE = (1 << 63) - 1
_WIDE = 1 << 31


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token of a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class PairTree:
    """Segment tree over the positions of a byte string; the root is the key of the next merge."""

    def __init__(self, piece: bytes, ranks: dict[bytes, int], longest: int) -> None:
        n = len(piece)
        self.piece, self.ranks, self.longest = piece, ranks, longest
        self.width = 1 << max(1, (n - 1).bit_length())
        self.tree = array("q", [_NONE]) * (2 * self.width)
        # end[i]: where the live token that starts at i ends, which is where its right neighbour starts.
        self.end = array("q", range(1, n + 1))
        self.before = array("q", range(-1, n - 1))
        width, tree = self.width, self.tree
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right

    def update(self, position: int, key: int) -> None:
        """Set one leaf and the nodes above it, up to the first that stays as it is."""
        tree, node = self.tree, self.width + position
        tree[node] = key
        while node > 1:
            left, right = tree[node & ~1], tree[node | 1]
            least = left if left < right else right
            node >>= 1
            if tree[node] == least:
                return
            tree[node] = least

    def pair_key(self, position: int) -> int:
        """Key of the pair that starts at a live position: its token and the one to its right."""
        middle = self.end[position]
        if middle == len(self.piece) or self.end[middle] - position > self.longest:
            return _NONE
        rank = self.ranks.get(self.piece[position : self.end[middle]])
        return _NONE if rank is None else rank * self.width + position

    def merge_all(self) -> list[int]:
        """Merge until no pair has a rank; the ids of the tokens left."""
        piece, end, before = self.piece, self.end, self.before
        while (key := self.tree[1]) != _NONE:
            at = key % self.width
            gone = end[at]
            end[at] = end[gone]
            if end[at] < len(piece):
                before[end[at]] = at
            self.update(gone, _NONE)
            self.update(at, self.pair_key(at))
            if before[at] >= 0:
                self.update(before[at], self.pair_key(before[at]))
        ids, at = [], 0
        while at < len(piece):
            ids.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return ids


class PairForest:
    """Trees of many short byte strings, merged in step: every round takes the root's pair of each string that has one.

    The same trees as :class:`PairTree`, one a row of a matrix.  A pair's rank is looked up by its two
    tokens in a sorted table of all ways to cut a token in two.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        cuts = [(ranks[t[:i]] * _WIDE + ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        cuts.sort()
        self.pairs, self.merged = (np.array(x, np.int64) for x in (zip(*cuts, strict=True) if cuts else ([-1], [0])))
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """Keys of the pairs of two tokens that start at some places; a token of -1 has no pair."""
        pair = left * _WIDE + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        met = (self.pairs[at] == pair) & (left >= 0) & (right >= 0)
        return np.where(met, self.merged[at] * width + place, _NONE)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of each; a piece has two bytes at least."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = 1 << max(1, int(size.max() - 1).bit_length())
        place, row = np.arange(width), np.arange(len(pieces))
        token = np.full((len(pieces), width), -1, np.int64)
        token[place < size[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        end, before = (np.tile(place + d, (len(pieces), 1)) for d in (1, -1))
        tree = np.full((len(pieces), 2 * width), _NONE)
        tree[:, width:-1] = self.keys(token[:, :-1], token[:, 1:], place[:-1], width)
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2

        def update(rows: np.ndarray, position: np.ndarray, key: np.ndarray | int) -> None:
            node = width + position
            tree[rows, node] = key
            for _ in range(width.bit_length() - 1):
                least = np.minimum(tree[rows, node], tree[rows, node ^ 1])
                node = node >> 1
                tree[rows, node] = least

        row = row[tree[:, 1] != _NONE]
        while len(row):
            rank, at = np.divmod(tree[row, 1], width)
            gone = end[row, at]
            after = end[row, gone]
            token[row, at], token[row, gone] = rank, -1
            end[row, at] = after
            more = after < size[row]
            before[row[more], after[more]] = at[more]
            update(row, gone, _NONE)
            right = np.where(more, token[row, np.minimum(after, width - 1)], -1)
            update(row, at, self.keys(rank, right, at, width))
            left = before[row, at]
            some = left >= 0
            update(row[some], left[some], self.keys(token[row[some], left[some]], rank[some], left[some], width))
            row = row[tree[row, 1] != _NONE]
        live = token >= 0
        return token[live], live.sum(axis=1)


class Encoder(dict):
    """Number of each match that was met; the ids of all of them lie end to end."""

    def __init__(self, data: bytes, pattern: str) -> None:
        super().__init__()
        self.ranks = read_ranks(data)
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"no tokens for bytes {missing}")
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.size_of = np.zeros(max(self.tokens) + 1, np.int64)
        self.size_of[list(self.tokens)] = [len(token) for token in self.tokens.values()]
        self.forest: PairForest | None = None  # made by the first match that needs it; decoding does not
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.ends = array("i"), array("q", [0])

    def match_ids(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else PairTree(piece, self.ranks, self.longest).merge_all()

    def _keep(self, matches: list[str], ids: np.ndarray | list[int], counts: np.ndarray | list[int]) -> None:
        self.update(zip(matches, range(len(self.ends) - 1, len(self.ends) - 1 + len(matches)), strict=True))
        self.ends.frombytes((len(self.ids) + np.cumsum(counts, dtype=np.int64)).tobytes())
        self.ids.frombytes(np.array(ids, np.int32).tobytes())

    def learn(self, matches: list[str]) -> None:
        """Number new matches; those of up to FOREST_BYTES bytes are merged together."""
        pieces = [match.encode() for match in matches]
        whole = list(map(self.ranks.get, pieces))
        known = [i for i, rank in enumerate(whole) if rank is not None]
        self._keep([matches[i] for i in known], [whole[i] for i in known], [1] * len(known))
        sizes: dict[int, list[int]] = {}
        for i, rank in enumerate(whole):
            if rank is None and len(pieces[i]) <= FOREST_BYTES:
                sizes.setdefault((len(pieces[i]) - 1).bit_length(), []).append(i)
            elif rank is None:
                ids = self.match_ids(pieces[i])
                self._keep([matches[i]], ids, [len(ids)])
        if sizes and self.forest is None:
            self.forest = PairForest(self.ranks)
        for found in sizes.values():
            for lo in range(0, len(found), FOREST_ROWS):
                part = found[lo : lo + FOREST_ROWS]
                self._keep([matches[i] for i in part], *self.forest.merge_all([pieces[i] for i in part]))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts end to end, and where each text begins and the last one ends."""
        if len(self) > KEPT or len(self.ids) > KEPT_IDS:
            self.forget()
        matches: list[str] = []
        bounds = [0]
        for text in texts:
            if text:
                matches += self.split(text)
            bounds.append(len(matches))
        numbers = list(map(self.get, matches))
        if None in numbers:
            self.learn(list({match for match, number in zip(matches, numbers, strict=True) if number is None}))
            numbers = list(map(self.get, matches))
        at = np.array(numbers, np.int64)
        ends = np.array(self.ends, np.int64)
        size = ends[at + 1] - ends[at]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = np.array(self.ids, np.int32)[np.arange(total[-1]) + np.repeat(ends[at] - total[:-1], size)]
        return flat, total[bounds]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int] | np.ndarray | None) -> bytes:
        """Bytes of a list of ids."""
        return b"".join(map(self.tokens.__getitem__, ids)) if ids is not None else b""

    def decode_all(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Bytes of lists of ids that lie end to end."""
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.size_of)):
            raise ValueError("ids outside the vocabulary")
        data = self.decode(flat.tolist())
        total = np.concatenate([[0], np.cumsum(self.size_of[flat])])[ends]
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(data)])


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    if (data, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[data, pattern] = Encoder(data, pattern)
    return _ENCODERS[data, pattern]


def _passing(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}, " for c in keep)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: doc_id) of every row and ``ids``, the token ids of its text as array<int>."""
    prepare(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    data = docs.sparkSession.sparkContext.broadcast(read_model(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value, pattern)
        try:
            for batch in batches:
                texts = batch.column(len(keep)).to_pylist()
                for lo, hi in text_parts(texts):
                    flat, ends = encoder.encode_all(texts[lo:hi])
                    ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]), ids], [*keep, "ids"])
        finally:
            encoder.forget()  # an idle worker keeps the vocabulary only

    slim = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias("_llm_text"))
    return slim.mapInArrow(run, f"{_passing(docs, keep)}ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) of every row and ``decoded``, the bytes that its ids stand for."""
    prepare(encoded.sparkSession)
    keep = encoded.columns if keep is None else keep
    data = encoded.sparkSession.sparkContext.broadcast(read_model(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value, pattern)
        for batch in batches:
            column = batch.column(len(keep))
            flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = encoder.decode_all(flat, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], [*keep, "decoded"])

    slim = encoded.select(*(F.col(f"`{c}`") for c in keep), F.col(ids_col).cast("array<int>").alias("_llm_ids"))
    return slim.mapInArrow(run, f"{_passing(encoded, keep)}decoded binary")
