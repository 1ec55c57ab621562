"""Toxicity scores from a factorization machine over hashed terms.

Terms are a text's lower-cased words and the beginnings of 3 to 7 bytes of its longer
words, each hashed to one of ``SLOTS`` slots.  From a bounded sample of labelled
rows (``TRAIN_ROWS``, by hash order of the id), the ``FEATURES`` slots that tell the
labels apart best are kept, and of the ``PAIR_SLOTS`` slots in most sample texts those
whose pairs tell the labels apart in a way that no two linear weights do (at most
``PAIR_FEATURES`` more).  So a term that says nothing by itself is kept for its
pairs, such as an insult that needs a group's mention.  The machine is

    score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

with x_i growing with the logarithm of a slot's count in the text.  The pair terms
weigh terms that say little alone and much together.  It is fitted on the driver
on that sample only, with a fixed seed and full-batch steps, so a fit is repeatable.
The labels weigh by their shares among all labelled rows, not by those in the sample.

Scoring is one pass over whole texts without a shuffle.  The labels, the sample
and the model are bounded by the parameters, whatever the tables hold.

Edge cases: null and empty texts have no terms and score by the bias alone; rows
of labels without a label or without a document are ignored, of a document's
several labels the largest counts; without labelled rows of both kinds every
score is the share of label 1 (0 without any); repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import Words, byte_table, chunks, mix, prepare, stage_table

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
BEGINNINGS = range(3, 8)
#: Characters between words: ASCII other than letters and digits.
BETWEEN = byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

#: Rows of each label at most in the training sample.
TRAIN_ROWS = 10_000
FEATURES = 256
#: Slots whose pairs are looked at, and slots kept for their pairs.
PAIR_SLOTS = 2048
PAIR_FEATURES = 32
#: Texts, and rows of the pair matrix, at a time.
PAIR_BLOCK = 256
FACTORS = 6
STEPS = 150
RATE = 0.05
#: Pull of weights and factors towards zero.
SHRINK = 2e-4


@dataclass(frozen=True)
class Machine:
    """A fitted factorization machine; ``table`` gives each slot's feature, or -1."""

    table: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        linear = self.bias + x @ self.weights
        pairs = 0.5 * (((x @ self.factors) ** 2).sum(axis=1) - (x**2) @ (self.factors**2).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(linear + pairs, -35, 35)))


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every term of some texts, repeats included."""
    words = Words(data, offs, BETWEEN, lower=True)
    docs, hashes = [words.doc], [mix(words.hash, 20)]
    for size in BEGINNINGS:
        longer, found = words.prefixes(size)
        docs.append(words.doc[longer])
        hashes.append(mix(found, 20 + size))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def features(data: np.ndarray, offs: np.ndarray, table: np.ndarray, count: int) -> np.ndarray:
    """Matrix of the feature values of some texts."""
    doc, slot = terms(data, offs)
    feature = table[slot]
    known = feature >= 0
    times = np.bincount(doc[known] * count + feature[known], minlength=(len(offs) - 1) * count)
    return np.log1p(times.reshape(len(offs) - 1, count)).astype(np.float32)


def _seen(data: np.ndarray, offs: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Texts of each label that hold each slot."""
    doc, slot = terms(data, offs)
    pairs = np.unique(doc * SLOTS + slot)
    doc, slot = pairs // SLOTS, pairs % SLOTS
    return np.stack([np.bincount(slot[labels[doc] == k], minlength=SLOTS) for k in (0, 1)])


def gain(clean: Column, toxic: Column, sizes: tuple[int, int]) -> Column:
    """Likelihood gain from knowing whether a slot is present in a text of either label."""
    usual = (clean + toxic + 0.5) / F.lit(sum(sizes) + 1.0)
    parts = []
    for seen, size in ((clean, sizes[0]), (toxic, sizes[1])):
        rate = (seen + 0.5) / F.lit(size + 1.0)
        parts.append(seen * F.log(rate / usual) + (F.lit(size) - seen) * F.log((1 - rate) / (1 - usual)))
    return parts[0] + parts[1]


def _interaction(cells: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Squared log-odds interaction over its variance, for the (clean, toxic) texts with both terms, either one, and none."""
    both, left, right, none = (np.log((toxic + 0.5) / (clean + 0.5)) for clean, toxic in cells)
    spread = sum(1 / (clean + 0.5) + 1 / (toxic + 0.5) for clean, toxic in cells)
    return (both - left - right + none) ** 2 / spread


def pair_slots(packed: np.ndarray, width: int, labels: np.ndarray, count: int = PAIR_FEATURES) -> np.ndarray:
    """Columns whose pairs tell the labels apart in a way that no weights of the two columns do, best first, at most ``count``.

    ``packed`` has a text's ``width`` columns as bits; they are unpacked ``PAIR_BLOCK`` texts at a time.  A pair counts if the interaction of its columns in
    the log-odds of label 1 exceeds what chance gives the best of all pairs.
    """
    sizes = np.array([(labels == 0).sum(), (labels == 1).sum()], np.float64)
    if width < 2 or not sizes.all():
        return np.zeros(0, np.int64)
    pairs = np.zeros((2, width, width), np.float32)  # counts of sample texts, exact as such
    for k in (0, 1):
        own = np.flatnonzero(labels == k)
        for at in range(0, len(own), PAIR_BLOCK):
            part = np.unpackbits(packed[own[at : at + PAIR_BLOCK]], axis=1, count=width).astype(np.float32)
            pairs[k] += part.T @ part
    alone = [p.diagonal().astype(np.float64) for p in pairs]
    # Chance gives the best of n pairs about 2 log n, on a scale of squared deviations.
    least = 2 * np.log(width * (width - 1) / 2.0) + 10.0
    found = []
    for at in range(0, width, PAIR_BLOCK):
        here = slice(at, min(at + PAIR_BLOCK, width))
        both = [p[here].astype(np.float64) for p in pairs]
        cells = [tuple(both)]
        cells.append(tuple(a[here, None] - b for a, b in zip(alone, both)))
        cells.append(tuple(a[None, :] - b for a, b in zip(alone, both)))
        cells.append(tuple(n - a[here, None] - a[None, :] + b for n, a, b in zip(sizes, alone, both)))
        strength = _interaction(cells)
        left, right = np.nonzero(np.triu(strength, at + 1) > least)
        best = np.argsort(-strength[left, right], kind="stable")[: count * count]
        found.append((strength[left[best], right[best]], left[best] + at, right[best]))
    gains, left, right = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(-gains, kind="stable")
    both = np.stack([left[order], right[order]], axis=1).ravel()
    first = np.sort(np.unique(both, return_index=True)[1])
    return both[first[:count]]


def fit(x: np.ndarray, y: np.ndarray, table: np.ndarray, seed: int = 7, steps: int = STEPS, odds: float | None = None) -> Machine:
    """Full-batch Adam on the logistic loss, both labels weighing alike up to a factor of ten.

    ``odds`` are those of label 1 among all labelled rows, where the sample given here has others.
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    share = float(y.mean()) if n else 0.0
    if not 0 < share < 1:
        sure = 35.0 if share else -35.0
        return Machine(table, sure, np.zeros(d, np.float32), np.zeros((d, FACTORS), np.float32))
    own = share / (1 - share)
    odds = own if odds is None else odds
    weight = np.where(y == 1, min(10.0 * odds, 1.0) / own, 1.0).astype(np.float32)
    weight /= weight.sum()
    params = [np.float32(np.log(odds)), np.zeros(d, np.float32), rng.normal(0, 0.02, (d, FACTORS)).astype(np.float32)]
    first, second = [0 * p for p in params], [0 * p for p in params]
    square = x**2
    for step in range(1, steps + 1):
        bias, w, v = params
        xv = x @ v
        raw = bias + x @ w + 0.5 * ((xv**2).sum(axis=1) - square @ (v**2).sum(axis=1))
        g = weight * (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - y)
        grads = [g.sum(), x.T @ g + SHRINK * w, x.T @ (g[:, None] * xv) - v * (square.T @ g)[:, None] + SHRINK * v]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad**2
            params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Machine(table, float(params[0]), params[1], params[2])


def _matrix(train: DataFrame, table: np.ndarray, count: int, bits: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Feature values of the training sample (their presence as packed bits) and its labels, in the order of the row hash."""
    schema = "place long, label int, x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in chunks(batch):
                found = features(data, offs, table, count)
                found = np.packbits(found > 0, axis=1) if bits else found.astype(np.float16)
                own = [batch.column(c).slice(rows.start, rows.stop - rows.start) for c in ("place", "label")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([x.tobytes() for x in found], pa.binary())], ["place", "label", "x"])

    # At most 2 * TRAIN_ROWS rows, each of FEATURES + PAIR_FEATURES small numbers or FEATURES + PAIR_SLOTS bits.
    rows = train.mapInArrow(run, schema).collect()
    rows.sort(key=lambda r: (r["place"], r["x"]))
    kind, width = (np.uint8, -(-count // 8)) if bits else (np.float16, count)
    x = np.frombuffer(b"".join(bytes(r["x"] or b"") for r in rows), kind).reshape(len(rows), width)
    return x if bits else x.astype(np.float32), np.array([r["label"] for r in rows], np.float32)


def _numbered(slots: np.ndarray) -> np.ndarray:
    """Table from each slot to its place in ``slots``, or -1."""
    table = np.full(SLOTS, -1, np.int16)
    table[slots] = np.arange(len(slots))
    return table


def train(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Machine:
    """Fit a machine on at most ``rows`` labelled documents of each label for whose id ``use`` (on ``doc_id``) holds."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    known = known.filter(use & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.withColumn("place", F.xxhash64("doc_id"))
    parts = [known.filter(F.col("label") == k).orderBy("place", "doc_id").limit(rows) for k in (0, 1)]
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    odds = shares[1] / shares[0] if len(shares) == 2 else None
    sample = F.broadcast(stage_table(parts[0].unionByName(parts[1]), "toxic-sample"))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # One row of a repeated id, that with the smallest text hash, so the sample stays bounded.
    chosen = slim.join(sample, "doc_id").groupBy("place", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    chosen = stage_table(chosen, "toxic-train")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sizes = np.zeros((2, SLOTS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            marks = batch.column("label").to_numpy()
            sizes += np.bincount(marks, minlength=2)
            for part, data, offs in chunks(batch):
                seen += _seen(data, offs, marks[part])
        some = np.flatnonzero(seen.any(axis=0))
        made = [pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])]
        yield pa.RecordBatch.from_arrays(made, ["slot", "clean", "toxic"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array(sizes[:1]), pa.array(sizes[1:])], ["slot", "clean", "toxic"])

    counted = stage_table(chosen.mapInArrow(count, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-terms")
    total = counted.filter("slot = -1").select("clean", "toxic").first() or (0, 0)
    ranked = counted.filter("slot >= 0 and clean + toxic >= 3").orderBy(gain(F.col("clean"), F.col("toxic"), tuple(total)).desc(), "slot")
    best = sorted(r["slot"] for r in ranked.limit(FEATURES).collect())
    seen = F.col("clean") + F.col("toxic")
    often = ranked.orderBy(F.least(seen, F.lit(sum(total)) - seen).desc(), "slot").limit(PAIR_SLOTS)
    paired = sorted({r["slot"] for r in often.collect()} - set(best))
    slots = np.array(best + paired, np.int64)
    packed, labels_seen = _matrix(chosen, _numbered(slots), len(slots), bits=True)
    alone = np.arange(len(slots)) < len(best)
    alone[pair_slots(packed, len(slots), labels_seen)] = True
    table = _numbered(slots[alone])
    return fit(*_matrix(chosen, table, int(alone.sum())), table, odds=odds)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, data, offs in chunks(batch, text_col):
                found = model.score(features(data, offs, model.table, len(model.weights))).astype(np.float64)
                made = [batch.column(id_col).slice(rows.start, rows.stop - rows.start), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(made, [id_col, "score", "predicted"])

    slim = docs.select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
