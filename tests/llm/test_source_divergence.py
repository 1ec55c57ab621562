"""Source divergence against a plain count in Python integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from slotwise.llm import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value long, shard int"


def plain(rows, min_docs=3, top=200, scale=10**9):
    in_docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        in_docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        mates = [s for x, s in groups if x == lang]

        def share(n, whole, kept=kept):
            return 1 + scale * (n + 1) // (whole + len(kept))

        total = {s: sum(counts[lang, s][t] for t in kept) for s in mates}
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in mates}
        q = {t: share(sum(counts[lang, s][t] for s in mates), sum(total.values())) for t in kept}
        pairs = [(s, sum((p[source][t] - p[s][t]) ** 2 // p[s][t] for t in kept)) for s in mates if s != source]
        terms = [(t, (p[source][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
        for part, found, last in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(found[:last], 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, *r, "clash", 1, 2, 3) for i, r in enumerate(rows)], SCHEMA)
    found = source_divergence.audit(df, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def corpus(seed, n, langs=("en", "de", None), sources=("a", "b", "c", None, "ä")):
    rng = random.Random(seed)
    words = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["été", "日本", "Ä", "ß"]
    rows = []
    for _ in range(n):
        weights = [1 / (1 + i) for i in range(len(words))]
        rows.append((" ".join(rng.choices(words, weights, k=rng.randrange(30))) + rng.choice(["", "!", "\n3x", "\x00"]), rng.choice(langs), rng.choice(sources)))
    return rows


@pytest.mark.parametrize("shard_rows", [1 << 17, 40])
def test_random_corpus(spark, shard_rows):
    rows = corpus(1, 400)
    assert run(spark, rows, shard_rows=shard_rows) == plain(rows)
    assert run(spark, rows, shard_rows=shard_rows, top=5, min_docs=1) == plain(rows, top=5, min_docs=1)


def test_edge_rows(spark):
    rows = [(None, "xx", "s"), ("", "xx", "t"), ("only twice", "xx", "s"), ("only twice", "xx", "s"), ("alone", "one", "s"), (None, None, None)]
    rows += [("a b c " * 50_000, "big", "hot")] + [("a b", "big", "hot")] * 50 + [("b c a", "big", "cold")] * 3 + [("Ä ä Z z", "big", "cold")] * 3
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_ties_rank_by_bytes(spark):
    rows = [("z ä é ｚ 𝒛 y", "t", "a")] * 3 + [("other", "t", "b")] * 3
    for top in (200, 3):
        assert run(spark, rows, top=top) == plain(rows, top=top)


def test_partial_counts_merge_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "STEP_BYTES", 100)
    rows = corpus(2, 100)
    assert run(spark, rows) == plain(rows)


def test_counts_too_large_for_one_product():
    import numpy as np

    n = np.array([0, 5, 10**13])
    assert source_divergence.shares(n, 10**14, 7, 10**9).tolist() == [1 + 10**9 * (x + 1) // (10**14 + 7) for x in n.tolist()]
