"""Quality rules on repetition inside one text, found with a suffix array over words.

Per text, a suffix array (prefix doubling) and the common prefixes of its
neighbours give, for every word, the longest repeat that starts there; these are
the ends of the LCP intervals, so the spans cover exactly the maximal repeated
substrings.  Spans of at least ``min_repeat`` words are united; a text is rejected
if they cover more than ``max_covered`` of its words or if one repeat is longer
than ``max_longest`` of its words.

Texts are independent: the work is one pass over the table without a shuffle, and
a task holds a few arrays over one slice of texts (or over one very long text).

Edge cases: a null or empty text has no words, fails the base rule (fewer than
``min_words``) and is not kept; repeated rows are judged alike; an empty table
gives an empty result; null ids and other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slotwise.llm.common import SPACE, Words, byte_table, chunks, prepare

SYMBOLS = byte_table(*((ord(c), ord(c)) for c in "#*$%&|<>"))
NEWLINE = byte_table((10, 10))


@dataclass(frozen=True)
class QualityRules:
    """Limits: base rule (``min_words``, ``max_repeat_pct`` of words in repeated 3-word windows) and the repeat rule."""

    min_words: int = 50
    max_repeat_pct: int = 50
    min_repeat: int = 8
    max_covered: float = 0.30
    max_longest: float = 0.25


def longest_repeats(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run of words from it that also starts elsewhere in its text.

    ``words`` are word hashes of texts laid end to end, ``doc`` the text of each
    position and ``ends`` the position where that text ends.
    """
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64)
    _, ids = np.unique(words, return_inverse=True)
    key = doc.astype(np.int64) * (n + 1) + ids
    rank = np.empty(n, np.int64)
    active = np.arange(n)
    levels: list[np.ndarray] = []
    length, classes = 0, np.zeros(n, np.int64)
    while len(active):
        order = np.argsort(key)
        active, key = active[order], key[order]
        place = np.arange(len(key))
        fresh, outer = np.ones(len(key), bool), np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        old = classes[active]
        outer[1:] = old[1:] != old[:-1]
        group = np.maximum.accumulate(np.where(fresh, place, 0))
        rank = classes.copy()
        rank[active] = old + group - np.maximum.accumulate(np.where(outer, place, 0))
        levels.append(rank.astype(np.int32))
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        active = active[~alone]
        length, classes = max(1, 2 * length), rank
        then = active + length
        inside = then < ends[active]
        second = np.where(inside, rank[np.minimum(then, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    same = doc[a] == doc[b]
    a, b = a[same], b[same]
    common = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        step = levels[j]
        p, q = a + common, b + common
        inside = (p < ends[a]) & (q < ends[b])
        equal = inside & (step[np.minimum(p, n - 1)] == step[np.minimum(q, n - 1)])
        common += equal * (1 << j)
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Positions inside the union of repeats of at least ``least`` words."""
    first = np.flatnonzero(best >= least)
    edge = np.zeros(len(best) + 1, np.int64)
    edge[first] += 1
    np.subtract.at(edge, first + best[first], 1)
    return np.cumsum(edge[:-1]) > 0


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(data: np.ndarray, offs: np.ndarray, rules: QualityRules) -> dict[str, np.ndarray]:
    """Counts and verdicts of texts given as UTF-8 bytes and offsets."""
    words = Words(data, offs)
    n = words.counts.astype(np.int64)
    in_word = ~SPACE[data]
    lines = Words(data, offs, NEWLINE)
    total = np.concatenate([[0], np.cumsum(in_word, dtype=np.int64)])
    filled = total[lines.ends] > total[lines.starts]
    pairs = np.stack([lines.doc[filled].astype(np.uint64), lines.hash[filled]])
    order = np.lexsort(pairs[::-1])
    pairs = pairs[:, order]
    again = np.zeros(pairs.shape[1], bool)
    again[1:] = (pairs[:, 1:] == pairs[:, :-1]).all(axis=0)
    best = longest_repeats(words.hash, words.doc, words.bounds[1:][words.doc] if len(words) else words.doc)
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, words.doc, best)
    out = {
        "n_words": n,
        "word_chars": _per_text(in_word & ((data & 0xC0) != 0x80), offs),
        "n_symbols": _per_text(SYMBOLS[data], offs),
        "n_dup_lines": np.bincount(pairs[0][again].astype(np.int64), minlength=len(n)),
        "n_repeat_words": _per_text(covered(best, 3), words.bounds),
        "n_covered": _per_text(covered(best, rules.min_repeat), words.bounds),
        "longest_repeat": longest,
    }
    out["base_failed"] = (n < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_pct * n)
    bad = (out["n_covered"] > rules.max_covered * n) | (longest > np.maximum(rules.min_repeat, rules.max_longest * n))
    out["kept"] = ~out["base_failed"] & ~bad
    return out


COLUMNS = [
    *((c, "long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ("base_failed", "boolean"),
    ("kept", "boolean"),
    ("n_covered", "long"),
    ("longest_repeat", "long"),
]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: the id, the counts of the base rule and of the repeat rule, and the verdict ``kept``."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in chunks(batch, text_col):
                found = measure(data, offs, rules)
                ids = batch.column(id_col).slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[c]) for c, _ in COLUMNS)], [id_col, *(c for c, _ in COLUMNS)])

    slim = docs.select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} {t}" for c, t in COLUMNS))


def keep(docs: DataFrame, text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [measure(data, offs, rules)["kept"] for _, data, offs in chunks(batch, text_col)]
            if masks:
                yield batch.filter(pa.array(np.concatenate(masks)))

    return docs.mapInArrow(run, docs.schema)
