"""Removed windows against counting every window."""

import random
from collections import Counter

import cases
import pytest
from pyspark.sql import functions as F
from slotwise.llm import substring_dedup as sd
from slotwise.llm.common import row_key


def expected(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        out.append((i, " ".join(x.decode() for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return out


def run(spark, rows, window=35):
    found = sd.remove_repeats(cases.table(spark, rows).drop("n_words"), window=window)
    return Counter(tuple(r) for r in found.select("doc_id", "text", "n_words", "n_removed").collect())


def test_edge_rows(spark):
    rows = cases.edge_rows()
    found = run(spark, rows)
    assert found == Counter(expected(rows, 35))
    assert sum(r[3] for r in found) > 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_cut_at_random_places(spark, seed):
    rng = random.Random(seed)
    passages = [t.split() for t in cases.sentences(seed, 4, 90, 30 if seed == 3 else 3000)]
    rows = []
    for i in range(80):
        words = cases.sentences(100 * seed + i, 1, rng.randrange(60), 3000)[0].split()
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            b = rng.randrange(a, len(p) + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = p[a:b]
        rows.append((i, " ".join(words)))
    rows += [(900, "x y " * 60), (901, "x y z " * 50)]
    for window in (6, 18, 35):
        assert run(spark, rows, window) == Counter(expected(rows, window))


def test_layout_keeps_the_text_around_cuts(spark):
    passage = cases.sentences(7, 1, 40)[0]
    rows = [(1, f"a  b\n{passage}\n c\td"), (2, passage + " e"), (3, " untouched\n\ntext ")]
    found = {r["doc_id"]: r["text"] for r in sd.remove_repeats(cases.table(spark, rows).drop("n_words"), layout=True).collect()}
    assert found == {1: "a  b\nc\td", 2: "e", 3: " untouched\n\ntext "}


def test_empty_table_and_short_window(spark):
    assert run(spark, []) == Counter()
    with pytest.raises(ValueError, match="window"):
        sd.remove_repeats(cases.table(spark, []), window=1)


def test_levels_double_until_none_survive(spark):
    passages = [t.split() for t in cases.sentences(77, 3, 100, 4000)]
    rows = [(1, " ".join(passages[0])), (2, "a " + " ".join(passages[0])), (3, " ".join(passages[0][:20])), (4, " ".join(passages[1][:7] + passages[2])), (5, " ".join(passages[1][:7]))]
    rows += [(6, None), (7, "x " * 30), (8, " ".join(passages[2][40:53])), (None, " ".join(passages[2][40:46]))]
    words = [(t or "").split() for _, t in rows]
    want = []
    for (i, _), own in zip(rows, words, strict=True):
        level, size = 0, 6
        while True:
            count = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
            if not any(count[tuple(own[k : k + size])] > 1 for k in range(len(own) - size + 1)):
                break
            level, size = size, 2 * size
        want.append((i, level))
    found = sd.repeat_levels(cases.table(spark, rows), window=6).select("doc_id", "level").collect()
    assert Counter(map(tuple, found)) == Counter(want)
    assert max(x for _, x in want) == 96
    assert sd.repeat_levels(cases.table(spark, [])).count() == 0


def test_an_extension_hash_of_zero_is_not_a_missing_one():
    import numpy as np
    from slotwise.llm import substring_dedup
    from slotwise.llm.common import Words

    text = " ".join(f"w{i}" for i in range(60)).encode()
    found = substring_dedup._runs(Words(np.frombuffer(text, np.uint8), np.array([0, len(text)])), 35)
    seed = substring_dedup.seed_size(35)
    place = found["first"] + found["at"]
    assert found["has_left"].tolist() == (place >= seed).tolist() and found["has_right"].tolist() == (place + 2 * seed <= 60).tolist()
    hashes = np.array([7, 7, 9 << 32, 0], np.uint64)  # the upper half of 7 is 0
    assert substring_dedup._half(hashes, np.array([True, False, True, False])).to_pylist() == [0, None, 9, None]


def test_repeated_rows_share_one_set_of_spans(spark):
    text = cases.sentences(41, 1, 300, 5000)[0]
    df = cases.table(spark, [(1, text)] * 60 + [(2, "other words " * 3)]).select("doc_id", "text")
    slim = df.select(*(c.alias(h) for c, h in zip(row_key("doc_id", "text"), sd.HIDDEN, strict=True)), F.col("text").alias("_llm_text"))
    spans = sd._repeated_spans(slim, 35).collect()
    assert len(spans) == 1 and len({tuple(s) for s in spans[0]["spans"]}) == len(spans[0]["spans"]) < 300
    assert {r["n_removed"] for r in sd.remove_repeats(df).filter("doc_id = 1").collect()} == {300}
