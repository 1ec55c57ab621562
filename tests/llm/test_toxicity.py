"""Factorization machine: interactions, held-out accuracy and edge cases."""

import math
import random
import re
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F
from slotwise.llm import toxicity as tx


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_pairs_that_linear_weights_miss():
    """Toxic only where exactly one of two terms is present: no linear score can tell."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (600, 2)).astype(np.float32)
    y = (x[:, 0] != x[:, 1]).astype(np.float32)
    machine = tx.fit(x, y, np.zeros(1, np.int16), steps=800)
    assert ((machine.score(x) >= 0.5) == (y == 1)).mean() > 0.99


def test_pairs_are_learned_through_train(spark):
    """Exactly one of two terms in 40 words of noise is toxic: neither term, nor their sum, tells anything."""
    rng = random.Random(5)
    rows, labels = [], []
    for i, text in enumerate(cases.sentences(51, 1500, 40, 800)):
        words = text.split()
        first, second = rng.random() < 0.5, rng.random() < 0.5
        words += ["outsiders"] * first + ["vermin"] * second
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(first != second)))
    docs = cases.table(spark, rows)
    machine = tx.train(docs, labelled(spark, labels), F.col("doc_id") % 3 != 1)
    found = {r["doc_id"]: r["score"] >= 0.5 for r in tx.score(docs, machine).collect()}
    held = [found[i] == bool(t) for i, _, t in labels if i % 3 == 1]
    assert sum(held) / len(held) > 0.95


def test_pair_slots_pass_over_noise_and_additive_terms():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (2000, 300))
    packed = np.packbits(x > 0, axis=1)
    either = (x[:, 7] != x[:, 290]).astype(np.float32)
    assert set(tx.pair_slots(packed, 300, either)) == {7, 290}
    added = (rng.random(2000) < 1 / (1 + np.exp(2 - 2 * x[:, 3] - 2 * x[:, 4]))).astype(np.float32)
    assert len(tx.pair_slots(packed, 300, added)) == 0


def test_labels_weigh_by_their_shares_in_the_whole_table():
    x = np.zeros((400, 1), np.float32)
    y = (np.arange(400) < 200).astype(np.float32)
    rare = tx.fit(x, y, np.zeros(1, np.int16), steps=800, odds=1 / 100)
    same = tx.fit(x, y, np.zeros(1, np.int16), steps=800)
    assert rare.score(x[:1])[0] == pytest.approx(1 / 11, abs=0.01) and same.score(x[:1])[0] == pytest.approx(0.5, abs=0.01)


def _slot(word: str, size: int | None) -> int:
    """Slot of a word, or of its beginning of ``size`` bytes."""
    data = np.frombuffer(word.encode(), np.uint8)
    _, slots = tx.terms(data, np.array([0, len(data)]))
    sizes = [None, *(n for n in tx.BEGINNINGS if len(data) > n)]
    return int(slots[sizes.index(size)])


def test_scores_equal_the_written_formula(spark):
    """Whole scores by regex words, a counter and a double loop over pairs of features."""
    rows = [r for r in cases.edge_rows() if r[0] is not None]
    texts = sorted({t or "" for _, t in rows}, key=len)[:-2]
    rng = np.random.default_rng(9)
    slots = sorted({_slot(w, n) for t in texts for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())[:9] for n in (None, 3) if n is None or len(w.encode()) > n})[:40]
    table = np.full(tx.SLOTS, -1, np.int16)
    table[slots] = np.arange(len(slots))
    machine = tx.Machine(table, 0.3, rng.normal(0, 0.5, len(slots)).astype(np.float32), rng.normal(0, 0.3, (len(slots), tx.FACTORS)).astype(np.float32))
    docs = cases.table(spark, list(enumerate(texts)))
    found = {r["doc_id"]: r["score"] for r in tx.score(docs, machine).collect()}
    for i, text in enumerate(texts):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        count = Counter()
        for word in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower):
            for size in (None, *tx.BEGINNINGS):
                if size is None or len(word.encode()) > size:
                    count[_slot(word, size)] += 1
        x = [math.log1p(count[s]) for s in slots]
        total = machine.bias + sum(float(w) * v for w, v in zip(machine.weights, x))
        for a in range(len(x)):
            for b in range(a + 1, len(x)):
                total += float(machine.factors[a] @ machine.factors[b]) * x[a] * x[b]
        assert found[i] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, total)))), abs=1e-4)


def test_insults_are_learned_and_held_out_texts_judged(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i, text in enumerate(cases.sentences(50, 500, 60, 900)):
        words, toxic = text.split(), i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Dolt!", "vermin", "oaf,", "wretched"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = cases.table(spark, rows)
    machine = tx.train(docs, labelled(spark, labels), F.col("doc_id") % 3 != 1)
    found = {r["doc_id"]: r["predicted"] for r in tx.score(docs, machine).collect()}
    held = [(found[i], t) for i, _, t in labels if i % 3 == 1]
    assert sum(p == t for p, t in held) / len(held) > 0.97


def test_same_fit_twice_and_edge_rows(spark):
    rows = cases.edge_rows()
    docs = cases.table(spark, rows)
    labels = labelled(spark, [(i, 1, i % 2) for i in range(1, 45)] + [(30, 0, 0), (2, None, None), (None, 1, 1), (999, 1, 1)])
    scores = []
    for parts in (1, 4):
        machine = tx.train(docs.repartition(parts), labels, F.lit(True))
        scores.append({(r["doc_id"], round(r["score"], 6)) for r in tx.score(docs, machine).collect()})
    assert scores[0] == scores[1]
    found = tx.score(docs, machine).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)


@pytest.mark.parametrize("labels", [[], [(10, 1, 1)], [(10, 1, 0), (11, 1, 0)]])
def test_labels_of_no_or_one_kind(spark, labels):
    docs = cases.table(spark, cases.edge_rows())
    machine = tx.train(docs, labelled(spark, labels), F.lit(True))
    want = {1.0} if labels and labels[0][2] else {0.0}
    assert {round(r["score"], 6) for r in tx.score(docs, machine).collect()} == want


def test_empty_table(spark):
    docs = cases.table(spark, [])
    assert tx.score(docs, tx.train(docs, labelled(spark, []), F.lit(True))).count() == 0
