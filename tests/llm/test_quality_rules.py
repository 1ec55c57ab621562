"""Suffix-array repetition against counting windows."""

from collections import Counter

import cases
import pytest
from slotwise.llm import quality_rules as q


def covered(words, size):
    count = Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    inside = set()
    for k in range(len(words) - size + 1):
        if count[tuple(words[k : k + size])] > 1:
            inside |= set(range(k, k + size))
    return len(inside)


def longest(words):
    lo = 0
    while any(c > 1 for c in Counter(tuple(words[k : k + lo + 1]) for k in range(len(words) - lo)).values()):
        lo += 1
    return lo


def expected(text, rules):
    words = (text or "").encode().split()
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    n, repeat, most = len(words), covered(words, 3), longest(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_pct * n
    bad = covered(words, rules.min_repeat) > rules.max_covered * n or most > max(rules.min_repeat, rules.max_longest * n)
    chars = sum(len(w.decode()) for w in words)
    return n, chars, sum(c in "#*$%&|<>" for c in text or ""), dup, repeat, failed, not failed and not bad, covered(words, rules.min_repeat), most


@pytest.fixture(scope="module")
def rows():
    base = cases.sentences(5, 3, 90)
    junk = [" ".join(["spam"] * 60), base[0] + "\n" + base[0], (base[1] + "\n") * 4, "# $% x\n# $% x\n" + base[2], base[0] + " " + base[1][:100] + " " + base[0][:100]]
    return [r for r in cases.edge_rows() if len(r[1] or "") < 5000] + [(100 + i, t) for i, t in enumerate(junk)]


def test_measures_equal_brute_force(spark, rows):
    found = q.score(cases.table(spark, rows)).collect()
    want = [(i, *expected(t, q.QualityRules())) for i, t in rows]
    assert Counter(map(tuple, found)) == Counter(want)
    assert any(r["base_failed"] for r in found) and any(r["kept"] for r in found)
    assert any(not r["kept"] and not r["base_failed"] for r in found)


def test_keep_returns_whole_rows(spark, rows):
    df = cases.table(spark, rows)
    want = Counter(tuple(r) for r in df.collect() if expected(r["text"], q.QualityRules())[6])
    assert Counter(map(tuple, q.keep(df).collect())) == want


def test_very_long_text_and_empty_table(spark):
    long = " ".join(cases.sentences(9, 40, 1000, 100000))
    found = q.score(cases.table(spark, [(1, long + " " + long)])).first()
    assert found["longest_repeat"] >= 40000 and not found["kept"]
    assert q.score(cases.table(spark, [])).count() == 0
    assert q.keep(cases.table(spark, [])).count() == 0
