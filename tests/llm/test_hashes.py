"""Words and runs of words with patterns on which weak hashes collide."""

import random
from collections import Counter

import cases
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from slotwise.llm import ngram_join, quality_rules, substring_dedup, toxicity
from slotwise.llm.common import Words, run_hash


def morse(letters: str, size: int) -> tuple[str, str]:
    """Two strings in Thue-Morse order, equal under every polynomial modulo 2**64 from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def words_of(*texts: str) -> Words:
    raw = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_patterned_words_and_runs_differ():
    for size in (1024, 2048, 4096):
        a, b = morse("ab", size)
        assert len(set(words_of(a, b, a + "a", b + "a").hash.tolist())) == 4
        left, right = morse("ab", size)
        words = words_of(" ".join(left), " ".join(right))
        runs = words.runs()
        both = run_hash(runs, words.bounds[:-1], words.bounds[1:])
        assert both[0] != both[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00é", min_size=1, max_size=40), min_size=1, max_size=30))
def test_hashes_tell_words_apart_wherever_they_stand(texts):
    words = words_of(" ".join(texts), " ".join(reversed(texts)))
    own = [t for t in texts] + list(reversed(texts))
    assert len(words) == len(own)
    assert len(set(zip(own, words.hash.tolist(), strict=True))) == len(set(own)) == len(set(words.hash.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab"]), min_size=2, max_size=80), st.integers(1, 70))
def test_runs_are_equal_where_their_words_are(own, size):
    words = words_of(" ".join(own), " ".join(own[::-1]))
    spans = [(a, min(a + size, b)) for a, b in ((i, words.bounds[words.doc[i] + 1]) for i in range(len(words)))]
    hashes = run_hash(words.runs(), np.array([a for a, _ in spans]), np.array([b for _, b in spans])).tolist()
    every = own + own[::-1]
    runs = [tuple(every[a:b]) for a, b in spans]
    assert len(set(zip(runs, hashes, strict=True))) == len(set(runs)) == len(set(hashes))


def test_operators_on_patterned_words(spark):
    a, b = morse("ab", 1024)
    rng = random.Random(1)
    rest = [f"w{rng.randrange(10**6)}" for _ in range(34)]
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, f"{a} {a}\n{b} {b}\n{a} {a}")]
    df = cases.table(spark, rows)
    cut = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df.drop("n_words")).collect()}
    assert cut[1]["n_removed"] == cut[2]["n_removed"] == 0 and cut[1]["text"] == rows[0][1]
    short = cases.table(spark, [(1, f"{a} x y z"), (2, f"{b} x y z"), (3, f"{a.upper()} x y z")])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(short).collect()} == {1: 1, 2: 2, 3: 1}
    found = {r["doc_id"]: r for r in quality_rules.score(df).collect()}
    assert found[3]["n_dup_lines"] == 1 and found[3]["n_repeat_words"] == 0 and found[1]["n_dup_lines"] == 0


def test_runs_of_patterned_words(spark):
    """Texts of two words in Thue-Morse order share no window of 1,024 words."""
    left, right = morse("ab", 1024)
    df = cases.table(spark, [(1, " ".join(left)), (2, " ".join(right))]).select("doc_id", "text")
    found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df, window=1024).collect()}
    assert found == {1: 0, 2: 0}


def test_slots_of_patterned_words():
    a, b = morse("ab", 1024)
    slots = []
    for text in (a, b):
        raw = np.frombuffer(text.encode(), np.uint8)
        slots.append(Counter(toxicity.terms(raw, np.array([0, len(raw)]))[1].tolist()))
    assert slots[0] != slots[1]
