"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

A text is written as the model sees it: a dummy space in front, spaces as
``▁``, no other normalisation.  No piece of such a model has a ``▁`` after another
character, so the lattice falls apart into units of spaces followed by
one word, and the best segmentation of a text is that of its units.

Per unit, a forward Viterbi pass gives every position its best score from the
left.  An A* search from the right end uses these scores as heuristic.  As they
are exact, a path followed by its best arrivals keeps its estimate, so the heap
only holds the next-best arrivals, and the first N complete paths are the N best.  A character without a piece is spelt in byte pieces, each scored ten
below the worst piece.

The N best of a text are the N smallest sums of losses against the best
segmentation, one per unit; only the N - 1 units with the cheapest second choice can
differ from it.  Only these units' other paths are walked and spelt.

Decoding joins pieces and bytes, turns ``▁`` into spaces and drops the dummy
space; it returns the text that was encoded, but that ``▁`` itself becomes a space.

Texts are independent: one pass without a shuffle.  A task keeps at most
``CACHE`` units and forgets them at its end.  The model file's path is a parameter; its bytes (half a megabyte)
travel with the task.

Edge cases: null and empty texts have no pieces, a score of 0 and decode to an
empty text, in one segmentation; a text with fewer segmentations than N has shorter lists; null ids pass
through; an empty table returns none.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import CHUNK_BYTES, prepare

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
CACHE = 1_000_000
#: Scores below this mark pieces that a model keeps but does not rank.
UNRANKED = -1e8
BYTE_PENALTY = 10.0


class Lattice:
    """Pieces of one model and the N-best segmentations of units over them."""

    def __init__(self, model: bytes, nbest: int) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        special = {i for i in range(sp.get_piece_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.text = [b""] * sp.get_piece_size()
        self.bytes = [0] * 256
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif i not in special:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} crosses a space")
                self.pieces[piece] = (i, sp.get_score(i))
                self.text[i] = piece.replace(SPACE, " ").encode()
        ranked = [s for _, s in self.pieces.values() if s > UNRANKED]
        self.byte_score = min(ranked, default=0.0) - BYTE_PENALTY
        # Pieces by their characters from the last to the first; key 0 holds (id, score).
        self.trie: dict = {}
        for piece, found in self.pieces.items():
            node = self.trie
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[0] = found
        self.size_of = np.array([len(x) for x in self.text], np.int64)
        self.at_of = np.cumsum(self.size_of) - self.size_of
        self.raw = np.frombuffer(b"".join(self.text), np.uint8)
        self.nbest = nbest

    def unit(self, unit: str) -> list[tuple[float, list[int]]]:
        """Up to ``nbest`` segmentations of a unit, best first: (score, ids)."""
        return next(self.units([unit], True))

    def units(self, units: list[str], spelt: bool = False) -> Iterator[list[tuple[float, list[int]]]]:
        """The segmentations of several units; in sorted order they share the Viterbi pass over common beginnings.

        Unless ``spelt``, only the best one has its ids.
        """
        # At each position: the pieces that arrive there, best first, as (best score with it, start, id).
        arriving: list[list[tuple]] = [[]]
        best = [0.0]
        before, trie = "", self.trie
        for unit in units:
            same = 0
            for a, b in zip(before, unit, strict=False):
                if a != b:
                    break
                same += 1
            before = unit
            del arriving[same + 1 :], best[same + 1 :]
            for end in range(same + 1, len(unit) + 1):
                start, ways = end - 1, []
                node = trie.get(unit[start])
                while node is not None:
                    if 0 in node:
                        piece, score = node[0]
                        ways.append((best[start] + score, start, piece))
                    if not start:
                        break
                    start -= 1
                    node = node.get(unit[start])
                if not ways or ways[0][1] != end - 1:
                    raw = unit[end - 1].encode()
                    ways.append((best[end - 1] + self.byte_score * len(raw), end - 1, tuple(self.bytes[b] for b in raw)))
                if len(ways) > 1:
                    ways.sort(reverse=True)
                arriving.append(ways)
                best.append(ways[0][0])
            yield self._search(arriving, best) if spelt else self._losses(arriving, best)

    def _search(self, arriving: list[list[tuple]], best: list[float]) -> list[tuple[float, list[int]]]:
        out: list[tuple[float, list[int]]] = []
        heap: list = [(0.0, 0, len(best) - 1, 0, None)]
        tick = 0
        while heap and len(out) < self.nbest:
            # The loss so far is exact, as every way back from here goes on with the best arrival.
            loss, _, at, rank, path = heappop(heap)
            ids: list[int] = []
            out.append((best[-1] - loss, ids))
            while at:
                ways = arriving[at]
                if rank + 1 < len(ways):
                    tick += 1
                    heappush(heap, (loss + ways[rank][0] - ways[rank + 1][0], tick, at, rank + 1, path))
                _, at, piece = ways[rank]
                path, rank = (piece, path), 0
            while path is not None:
                if type(path[0]) is int:
                    ids.append(path[0])
                else:
                    ids += path[0]
                path = path[1]
        return out

    def _losses(self, arriving: list[list[tuple]], best: list[float]) -> list[tuple[float, list[int]]]:
        """As ``_search``, in the same order, with the ids of the best one only.

        The ways left are a list that is searched once for each of the few segmentations; of
        equal losses the first one counts, as in the heap.
        """
        at, top, walked = len(best) - 1, best[-1], []
        losses, places = [], []
        while at:
            ways = arriving[at]
            first = ways[0]
            if len(ways) > 1:
                losses.append(first[0] - ways[1][0])
                places.append((at, 1))
            walked.append(first[2])
            at = first[1]
        ids: list[int] = []
        for piece in reversed(walked):
            if type(piece) is int:
                ids.append(piece)
            else:
                ids += piece
        out = [(top, ids)]
        while losses and len(out) < self.nbest:
            number = losses.index(min(losses))
            loss, (at, rank) = losses.pop(number), places.pop(number)
            out.append((top - loss, []))
            if len(out) == self.nbest:
                break
            while at:
                ways = arriving[at]
                own = ways[rank]
                rank += 1
                if rank < len(ways):
                    losses.append(loss + own[0] - ways[rank][0])
                    places.append((at, rank))
                at, rank = own[1], 0
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all ids end to end, and where each id's bytes begin."""
        size = self.size_of[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        kind = np.int32 if total[-1] < 1 << 31 else np.int64
        places = np.repeat((self.at_of[ids] - total[:-1]).astype(kind), size)
        places += np.arange(total[-1], dtype=kind)
        return self.raw[places].tobytes(), total

    def round_trips(self, ids: np.ndarray, ends: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> list[bool]:
        """Whether each segmentation of a text decodes to it; segmentations are ranges of ``ids``, texts ranges of segmentations."""
        data, total = self.decode_all(ids)
        at, same = total[ends].tolist(), []
        for lo, hi, text in zip(counts[:-1].tolist(), counts[1:].tolist(), texts, strict=True):
            own = b" " + text if text else b""  # with the dummy space in front
            same.append(all(data[at[i] : at[i + 1]] == own for i in range(lo, hi)))
        return same


class Encoder(dict):
    """Number of each unit seen; its segmentations lie in flat arrays."""

    def __init__(self, model: bytes, nbest: int) -> None:
        super().__init__()
        self.lattice, self.nbest = Lattice(model, nbest), nbest
        self._clear()

    def _clear(self) -> None:
        self.clear()
        self.ids, self.ends, self.scores = array("i"), array("q", [0]), array("d")
        self.losses = array("d")
        self.spelt: dict[str, list[np.ndarray]] = {}

    def _learn(self, units: list[str]) -> None:
        flat: list[int] = []
        ends, scores, losses, first = [], [], [], len(self.ids)
        none = [np.inf] * (self.nbest - 1)
        for found in self.lattice.units(units):
            best, ids = found[0]
            flat += ids
            ends.append(first + len(flat))
            scores.append(best)
            if len(found) == self.nbest == 3:
                losses.append(best - found[1][0])
                losses.append(best - found[2][0])
            else:
                losses += ([best - s for s, _ in found[1:]] + none)[: self.nbest - 1]
        self.update(zip(units, range(len(self.scores), len(self.scores) + len(units)), strict=True))
        for kept, new, kind in ((self.ids, flat, np.int32), (self.ends, ends, np.int64), (self.scores, scores, np.float64), (self.losses, losses, np.float64)):
            kept.frombytes(np.array(new, kind).tobytes())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[float]]]:
        """Ids of the best segmentations end to end, their ends, and the N best scores of each text."""
        _, bounds, flat, total, scores, _ = self._encode(texts)
        return flat, total[bounds], scores

    def encode_all(self, texts: list[str | None]) -> tuple[list[list[np.ndarray]], list[list[float]]]:
        """The ids of the N best segmentations of each text, best first, and their scores."""
        units, bounds, flat, total, scores, choices = self._encode(texts)
        found = []
        for lo, hi, ways in zip(bounds[:-1], bounds[1:], choices, strict=True):
            own = []
            for way in ways:
                parts, at = [], total[lo]
                for row, rank in sorted(way):
                    parts += [flat[at : total[lo + row]], self._other(units[lo + row], rank)]
                    at = total[lo + row + 1]
                parts.append(flat[at : total[hi]])
                own.append(np.concatenate(parts) if way else parts[0])
            found.append(own)
        return found, scores

    def _other(self, unit: str, rank: int) -> np.ndarray:
        if unit not in self.spelt:
            self.spelt[unit] = [np.array(ids, np.int32) for _, ids in self.lattice.unit(unit)]
        return self.spelt[unit][rank]

    def _encode(self, texts: list[str | None]) -> tuple:
        """The texts' units, their bounds by text, the best ids and their ends by unit, and by text the N best scores and choices."""
        if len(self) > CACHE:
            self._clear()
        units: list[str] = []
        bounds = [0]
        for text in texts:
            if text:
                units += UNIT.findall(SPACE + text.replace(" ", SPACE))
            bounds.append(len(units))
        known = list(map(self.get, units))
        if None in known:
            self._learn(sorted({unit for unit, number in zip(units, known, strict=True) if number is None}))
            known = list(map(self.get, units))
        if not units:
            return units, bounds, np.zeros(0, np.int32), np.zeros(1, np.int64), [[0.0] for _ in texts], [[()] for _ in texts]
        numbers = np.array(known, np.int64)
        ends = np.frombuffer(self.ends, np.int64)  # the views end with this call, before the arrays grow again
        first, size = ends[numbers], ends[numbers + 1] - ends[numbers]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(self.ids, np.int32)[np.arange(total[-1]) + np.repeat(first - total[:-1], size)]
        best = np.concatenate([[0.0], np.cumsum(np.frombuffer(self.scores)[numbers])])
        losses = np.frombuffer(self.losses).reshape(-1, self.nbest - 1)[numbers] if self.nbest > 1 else np.zeros((len(numbers), 0))
        scores, choices = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            top = float(best[hi] - best[lo])
            sums = _smallest_sums(losses[lo:hi], self.nbest)
            scores.append([top - x for x, _ in sums])
            choices.append([way for _, way in sums])
        return units, bounds, flat, total, scores, choices

    def segmentations(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations of one text: (score, ids)."""
        units = UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []
        best: list[tuple[float, list[int]]] = [(0.0, [])]
        for unit in units:
            own = self.lattice.unit(unit)
            best = heapq.nsmallest(self.nbest, ((a[0] + b[0], a[1] + b[1]) for a in best for b in own), key=lambda x: -x[0])
        return best


def _smallest_sums(losses: np.ndarray, nbest: int) -> list[tuple[float, tuple]]:
    """The ``nbest`` smallest sums of one loss per row, where a row also has the loss 0, each with the (row, rank) of its other losses.

    Of rows with equal losses the first count.
    """
    sums: list[tuple[float, tuple]] = [(0.0, ())]
    if losses.shape[1] == 0 or not len(losses):
        return sums
    second = losses[:, 0]
    few = np.arange(len(second))
    if len(second) >= nbest:
        most = np.partition(second, nbest - 2)[nbest - 2]
        few = np.concatenate([np.flatnonzero(second < most), np.flatnonzero(second == most)])[: nbest - 1]
    for row in few[np.argsort(second[few], kind="stable")].tolist():
        own = [(0.0, ()), *((x, ((row, k),)) for k, x in enumerate(losses[row].tolist(), 1) if x < np.inf)]
        sums = heapq.nsmallest(nbest, ((a + b, v + w) for a, v in sums for b, w in own), key=itemgetter(0))
    return sums


_ENCODERS: dict[tuple[bytes, int], Encoder] = {}


def _encoder(model: bytes, nbest: int) -> Encoder:
    key = (model, nbest)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, nbest)
    return _ENCODERS[key]


def text_parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES characters."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_BYTES or i == len(texts) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", nbest: int = 3) -> DataFrame:
    """One row per document: the id, ``n_bytes``, ``ids`` of the best segmentation, ``scores`` and ids (``segmentations``) of the N best, and ``round_trip``.

    ``round_trip`` tells whether decoding each of the segmentations gives the text back; for a
    text with ``▁`` it does not, as the model takes that for a space.
    """
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value, nbest)
        try:
            for batch in batches:
                texts = batch.column(text_col).to_pylist()
                for lo, hi in text_parts(texts):
                    found, scores = encoder.encode_all(texts[lo:hi])
                    flat = [ids for own in found for ids in own]
                    ends, counts = (np.cumsum([0, *map(len, x)]).astype(np.int32) for x in (flat, found))
                    every, raw = np.concatenate(flat), [(t or "").encode() for t in texts[lo:hi]]
                    same = encoder.lattice.round_trips(every, ends, counts, raw)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(id_col).slice(lo, hi - lo),
                            pa.array([len(t) for t in raw], pa.int64()),
                            pa.array(scores, pa.list_(pa.float64())),
                            pa.array(same),
                            pa.ListArray.from_arrays(pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), pa.array(every))),
                        ],
                        [id_col, "n_bytes", "scores", "round_trip", "segmentations"],
                    )
        finally:
            encoder._clear()  # an idle worker keeps no cache

    slim = docs.select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()
    found = slim.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, scores array<double>, round_trip boolean, segmentations array<array<int>>")
    return found.select(id_col, "n_bytes", F.get("segmentations", F.lit(0)).alias("ids"), "scores", "round_trip", "segmentations")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: the id and the ``text`` that its piece ids spell; null ids spell an empty text."""
    prepare(encoded.sparkSession)
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _encoder(model.value, 1).lattice
        for batch in batches:
            texts = [lattice.decode(ids or []) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    slim = encoded.select(id_col, ids_col)
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, text string")
