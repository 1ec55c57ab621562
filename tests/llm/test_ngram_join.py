"""N-gram Jaccard components against all pairs."""

import random
from collections import Counter

import cases
import numpy as np
from slotwise.llm import ngram_join as nj
from slotwise.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    """Components over ids (rows without one by their text)."""
    key = [("id", i) if i is not None else ("text", t) for i, t in rows]
    sets = [shingles(t) for _, t in rows]
    root = {k: k for k in key}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(key[a])] = find(key[b])
    low = {}
    for k in key:
        if k[0] == "id":
            low[find(k)] = min(low.get(find(k), k[1]), k[1])
    return Counter((i, len(s), low.get(find(k))) for (i, _), s, k in zip(rows, sets, key, strict=True))


def run(spark, rows):
    found = nj.ngram_components(cases.table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    return Counter(map(tuple, found))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_edge_rows(spark):
    assert run(spark, cases.edge_rows()) == expected(cases.edge_rows())


def test_near_copies_common_passages_and_blocks(spark, monkeypatch):
    rng = random.Random(4)
    bases, common = cases.sentences(11, 6, 150, 5000), cases.sentences(12, 1, 60, 5000)[0]
    rows = [(i, edited(rng, bases[i % 3], rng.randrange(8))) for i in range(120)]
    rows += [(200 + i, edited(rng, common, 0) + " " + t) for i, t in enumerate(cases.sentences(13, 60, 25, 5000))]
    rows += [(300 + i, bases[4]) for i in range(40)] + [(400, bases[4] + " more"), (401, edited(rng, bases[5], 2)), (402, bases[5])]
    monkeypatch.setattr(nj, "BLOCK", 8)
    assert run(spark, rows) == expected(rows)


def test_any_heat_keeps_every_link(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, edited(rng, b, rng.randrange(4))) for i, b in enumerate(cases.sentences(21, 8, 60, 300) * 6)]
    monkeypatch.setattr(nj, "heat", lambda counts: np.where(np.arange(len(counts)) % 3 == 0, 500.0, 0.0))
    assert run(spark, rows) == expected(rows)


def test_keep_one_of_each_component(spark):
    """Rows of one id with unlike texts are documents of their own."""
    base = cases.sentences(31, 3, 60, 5000)
    rows = cases.edge_rows() + [(50, base[0]), (51, base[1]), (51, base[2]), (52, base[2]), (53, base[0] + " tail"), (51, base[2])]
    df = cases.table(spark, rows)
    kept = nj.keep_one(df).collect()
    assert kept and set(map(tuple, kept)) <= set(map(tuple, df.collect()))
    # One of each component of distinct (id, text) rows, that with the smallest id; no id is larger than any.
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets, left, groups = [shingles(t) for _, t in distinct], list(range(len(distinct))), []
    while left:
        group, todo = [], [left.pop(0)]
        while todo:
            x = todo.pop()
            group.append(x)
            near = [y for y in left if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
            left = [y for y in left if y not in near]
            todo += near
        groups.append(group)
    assert Counter(r["doc_id"] for r in kept) == Counter(distinct[min(g)][0] for g in groups)
    assert {(51, base[1]), (51, base[2]), (50, base[0])} <= {(r["doc_id"], r["text"]) for r in kept}


def test_components_of_a_chain_and_a_ring(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert run(spark, []) == Counter()
    assert nj.keep_one(cases.table(spark, [])).count() == 0
