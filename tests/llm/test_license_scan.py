"""License scan against plain TF-IDF vectors and walking up the directories."""

import math
import re
from collections import Counter

import cases
import pytest
from pyspark.sql import functions as F
from slotwise.llm import license_scan as ls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER)) if w]


def own_licence(texts):
    counts = [(n, Counter(words(t))) for n, t in ls.TEMPLATES]
    vocabulary = {w for _, c in counts for w in c}
    df = Counter(w for t in texts for w in vocabulary & set(words(t)))
    weight = lambda w: math.log((len(texts) + 1) / ((df[w] if w in vocabulary else 0) + 1)) + 1
    vector = lambda c: {w: k * weight(w) for w, k in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(n, v := vector(c), norm(v)) for n, c in counts]

    def best(text):
        top, name, part = 0.0, None, []
        segments = []
        for line in [*(text or "").split("\n"), ""]:
            found = words(line)
            if found:
                segments.append(found)
                part += found
            elif part:
                segments.append(part)
                part = []
        for segment in segments:
            v = vector(Counter(segment))
            for n, t, size in known:
                cosine = sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / size
                if cosine > top + 1e-9:
                    top, name = cosine, n
        return (name, top) if top >= 0.8 else (None, None)

    return best


def expected(rows):
    best = own_licence([t for _, t in rows])
    own = [best(t)[0] for _, t in rows]
    given = {}
    for (path, _), name in sorted(zip(rows, own, strict=True), key=lambda x: x[0][0] or "", reverse=True):
        if path and name and re.search(r"(?i)(^|/)(licen[cs]e|copying)[^/]*$", path):
            given[path.rpartition("/")[0]] = name
    out = Counter()
    for (path, _), name in zip(rows, own, strict=True):
        how, found = ("own", name) if name else (None, None)
        up = path.rpartition("/")[0] if path is not None else None
        while found is None and up is not None:
            if up in given:
                found, how = given[up], "inherited"
            up = up.rpartition("/")[0] if up else None
        out[(path, found, how)] += 1
    return out


def run(spark, rows):
    df = spark.createDataFrame([(p, t, "c") for p, t in rows], "path string, text string, own string")
    return Counter((r["path"], r["license"], r["how"]) for r in ls.scan(df).collect())


@pytest.fixture(scope="module")
def rows():
    mit, apache, gpl = (next(t for n, t in ls.TEMPLATES if n == k and len(t) > 60) for k in ("MIT", "Apache-2.0", "GPL-3.0"))
    prose = cases.sentences(60, 12, 40)
    wrapped = "\n".join(gpl.split("also", 1)[0].split(". ")).replace(" ", " ", 1)
    return [
        ("LICENSE", mit), ("readme.txt", prose[0]), ("a/x.py", prose[1]), ("a/b/COPYING.txt", f"{prose[2]}\n\n{gpl}\n"), ("a/b/y.py", prose[3]), ("a/b/c/d/z.py", prose[4]),
        ("a/b2/z.py", prose[5]), ("a/b/c/d/own.py", f"# {apache}\n\n{prose[6]}"), ("a/b/License", apache), ("k/licence.md", prose[7]), ("k/l/m.py", prose[8]), (None, prose[9]), (None, mit),
        ("a/n.txt", None), ("a/e.txt", ""), ("a/b/y.py", prose[3]), ("k/all.txt", "All rights reserved."), ("k/long.txt", " ".join(cases.sentences(61, 30, 100)) + "\nReleased under the MIT License."),
        ("w/wrapped.txt", wrapped + "\n" + prose[10]), ("/abs/f", prose[11]),
    ]


def test_licences_and_inheritance(spark, rows):
    found = run(spark, rows)
    assert found == expected(rows)
    assert ("a/b/c/d/z.py", "GPL-3.0", "inherited") in found and ("a/b2/z.py", "MIT", "inherited") in found


def test_without_licence_files(spark, rows):
    some = [r for r in rows if r[0] and "icen" not in r[0].lower() and "COPY" not in r[0]]
    assert run(spark, some) == expected(some)


def test_empty_table_and_kept_columns(spark, rows):
    assert run(spark, []) == Counter()
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "n int, path string, text string")
    assert sorted(r["n"] for r in ls.scan(df, keep=["n"]).collect()) == list(range(len(rows)))


def test_equal_cosines_take_the_first_template(spark):
    df = spark.createDataFrame([("a/f", "same words here")], "path string, text string")
    assert ls.scan(df, templates=[("X", "same words here"), ("Y", "here same words")]).first()["license"] == "X"
    assert ls.scan(df.withColumn("text", F.lit("none at all")), templates=[("X", "same words here")]).first()["license"] is None


def true_cosines(texts, templates):
    """TF-IDF with the document frequencies of all terms: the best name and cosine of each text's only paragraph."""
    df = Counter(w for t in texts for w in set(words(t)))
    vector = lambda t: {w: k * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) for w, k in Counter(words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(n, vector(t)) for n, t in templates]
    out = []
    for text in texts:
        v = vector(text)
        found = [(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), n) for n, t in known]
        out.append(max(found, key=lambda x: x[0]))
    return out


def test_frequencies_of_all_terms(spark):
    """Words that stand in every file pull no notice below the limit, and at a larger size the verdict stays."""
    for files in (40, 400):
        notice = "Copyright (c) 2024 Foo Bar. Released under the MIT License."
        texts = [notice, "foo bar of 2024 released under the mit license", "rare words here all rights reserved", *(f"copyright c 2024 foo bar page{i}" for i in range(files))]
        df = spark.createDataFrame([(i, f"f{i}", t) for i, t in enumerate(texts)], "n int, path string, text string")
        found = {r["n"]: (r["license"], r["cosine"]) for r in ls.scan(df, keep=["n"]).collect()}
        want = true_cosines(texts, ls.TEMPLATES)
        assert found == {i: (n, pytest.approx(c, abs=1e-8)) if c >= 0.8 else (None, None) for i, (c, n) in enumerate(want)}
        assert found[0][0] == "MIT" and found[2] == (None, None)


def test_whole_licence_paragraphs(spark):
    texts = {
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\nIf a copy of the MPL was not distributed with this file,\nYou can obtain one at https://mozilla.org/MPL/2.0/.",
    }
    df = spark.createDataFrame([(n, t) for n, t in texts.items()] + [("none", t) for t in cases.sentences(9, 20, 30)], "path string, text string")
    found = {r["path"]: (r["license"], r["cosine"]) for r in ls.scan(df).collect()}
    assert found == {n: (n, pytest.approx(1.0)) for n in texts} | {"none": (None, None)}


def test_kept_columns_of_any_name(spark):
    names = ["score", "own", "text", "cosine", "dir", "later", "which", "given", "value", "path", "how", "license"]
    rows = [(f"a/{i}.c", "plain text", *(f"{n}{i}" for n in names)) for i in range(3)]
    df = spark.createDataFrame(rows, "p string, body string, " + ", ".join(f"`{n}` string" for n in names))
    found = ls.scan(df, path_col="p", text_col="body", keep=names)
    assert found.columns[-4:] == ["path", "license", "how", "cosine"]
    shown = [f"{n}_kept" if n in ("path", "license", "how", "cosine") else n for n in names]
    assert found.columns[:-4] == shown
    assert sorted(tuple(r[: len(names)]) for r in found.collect()) == [tuple(f"{n}{i}" for n in names) for i in range(3)]
