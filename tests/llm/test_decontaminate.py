"""Benchmark hits against every window of every text."""

import re
from collections import Counter

import cases
import pytest
from slotwise.llm import decontaminate as dc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            if w:
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def run(spark, rows, items):
    found = dc.find_hits(cases.table(spark, rows), cases.table(spark, items, "item_id")).collect()
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in found)


@pytest.fixture(scope="module")
def data():
    texts = cases.sentences(31, 6, 40, 2000)
    short = ["zebra", "alpha beta", "Gamma, delta! epsilon", "p q r s t u v", "a1 a2 a3 a4 a5 a6 a7 a8 a9", " ".join(f"k{i}" for i in range(12))]
    items = list(enumerate([*texts, *short, texts[0], None, "", "?!"])) + [(99, " ".join(texts[1].split()[5:25]))]
    cut = texts[2].split()
    rows = cases.edge_rows() + [
        (50, texts[0]), (51, "pre " + texts[1].upper() + " post"), (52, " ".join(cut[3:16])), (53, " ".join(cut[3:15])), (54, "a zebra! here"), (55, "beta alpha beta"),
        (56, " ".join(cases.sentences(40, 1, 900)[0].split() + cut)), (57, "GAMMA-delta/epsilon"), (58, "p q r s t u"), (59, " ".join(f"k{i}" for i in range(14))), (60, "x1 a1 a2 a3 a4 a5 a6 a7 a8 a9 a1"),
    ]
    return rows, items


def test_hits_equal_brute_force(spark, data):
    assert run(spark, *data) == Counter(expected(*data))


def test_shuffled_benchmark_side(spark, data, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 3)
    long = [(i, t) for i, t in data[1] if len(words(t)) >= 13]
    assert run(spark, data[0], long) == Counter(expected(data[0], long))


def test_drop_contaminated(spark, data):
    rows, items = data
    df = cases.table(spark, rows)
    bad = {(i, t) for (i, t), x in zip(rows, expected(rows, items), strict=True) if x[4]}
    kept = dc.drop_contaminated(df, cases.table(spark, items, "item_id"))
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in df.collect() if (r["doc_id"], r["text"]) not in bad)


def test_empty_tables(spark, data):
    assert run(spark, [], data[1]) == Counter()
    assert run(spark, data[0], []) == Counter(expected(data[0], []))


def test_no_python_in_the_plan(spark, data, sf_dir):
    found = dc.find_hits(cases.table(spark, data[0]).coalesce(1), cases.table(spark, data[1], "item_id"))
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD", ""))


def test_texts_of_suspects_are_read_without_a_shuffle(spark, data, monkeypatch):
    plans = {}
    stage = dc.stage_table

    def staged(df, name):
        if name == "suspects":
            # As on large tables, where Spark does not broadcast by its own estimate.
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            try:
                plans[name] = df.select("*")._jdf.queryExecution().executedPlan().toString()
            finally:
                spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        return stage(df, name)

    monkeypatch.setattr(dc, "stage_table", staged)
    assert run(spark, *data) == Counter(expected(*data))
    assert "BroadcastHashJoin" in plans["suspects"] and "SortMergeJoin" not in plans["suspects"]
