"""License scan: sparse TF-IDF cosine to templates, then inheritance along directories.

1. Document frequencies of all terms are counted over all files, a grouped sum.
2. Every line and every paragraph (lines up to a blank one) of a file is a candidate
   header; a licence file is one whose paragraphs are a licence text.  Vectors are
   sparse, tf times idf.  The best cosine from ``least`` on gives the file's own licence.
   No term weighs less than one that all files hold, which bounds a candidate's cosine
   from the templates' terms alone.  Only the other words of candidates whose bound
   reaches ``least`` are joined with their frequencies, equal candidates once.
3. A file without one inherits from the licence file of the nearest directory above
   it.  Distinct directories are joined, path by path, with all their ancestors, so
   the join grows with directories times depth, not with files.

The scan itself is a pass without a shuffle, whatever a file's size; the templates and
their terms are a parameter of bounded size, and the other terms' frequencies stay a
table that no process holds whole.  Of two templates with equal cosine
the first in the list counts, and of several licence files of a directory the one
with the smallest path.

Edge cases: null and empty texts have no licence of their own; a null path has no
directory and inherits nothing; repeated rows give one row each; an empty table
returns none; kept columns come back whatever their names, one named like a result column
with ``_kept`` behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import Words, byte_table, chunks, mix, prepare, signed, skew_join, stage_table

BETWEEN = byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Terms that a task keeps before it hands on their counts.
TERMS = 1 << 20
#: More than rounding can move a cosine.
SLACK = 1e-8

_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
)

#: SPDX name and notice texts of common licences: the short notices and
#: opening clauses, then the paragraphs that name one licence, and the whole texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("Apache-2.0", _APACHE[0]),
    ("Apache-2.0", _APACHE[1]),
    ("Apache-2.0", " ".join(_APACHE)),
    ("BSD-3-Clause", _BSD[3]),
    ("BSD-3-Clause", " ".join(_BSD[:4])),
    ("BSD-3-Clause", " ".join(_BSD)),
    ("GPL-3.0", " ".join(_GPL)),
    ("ISC", _ISC[0]),
    ("ISC", _ISC[1]),
    ("ISC", " ".join(_ISC)),
    ("MIT", _MIT[0]),
    ("MIT", " ".join(_MIT[:2])),
    ("MIT", _MIT[2]),
    ("MIT", " ".join(_MIT)),
    ("MPL-2.0", _MPL[0]),
)


def _words(texts: Sequence[str]) -> Words:
    raw = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), BETWEEN, lower=True)


class Templates:
    """Term hashes of the templates and, once document frequencies are known, their unit vectors."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES) -> None:
        self.names = [n for n, _ in templates]
        words = _words([t for _, t in templates])
        self.terms, term = np.unique(words.hash, return_inverse=True)
        self.counts = np.zeros((len(templates), len(self.terms)))
        np.add.at(self.counts, (words.doc, term), 1)
        self.idf, self.units = np.zeros(len(self.terms)), self.counts

    def weigh(self, df: np.ndarray, files: int) -> None:
        self.idf = np.log((files + 1) / (df + 1)) + 1
        vectors = self.counts * self.idf
        self.units = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)

    def term_of(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each template term, -1 for other words."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def _segments(data: np.ndarray, words: Words) -> list[np.ndarray]:
    """The line and the paragraph of each word, numbered over all texts."""
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, words.starts)
    new_text = np.ones(len(words), bool)
    new_text[1:] = words.doc[1:] != words.doc[:-1]
    new_line = new_text.copy()
    new_line[1:] |= line[1:] != line[:-1]
    new_part = new_text.copy()
    new_part[1:] |= line[1:] > line[:-1] + 1
    return [np.cumsum(new_line) - 1, np.cumsum(new_part) - 1]


def best_templates(data: np.ndarray, offs: np.ndarray, templates: Templates, least: float) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """For each text the best cosine of a line or paragraph of template terms only, its template (-1 without one), and the open candidates.

    Open are those with other words, too, if these could weigh so little that the cosine reaches ``least``.
    """
    words = Words(data, offs, BETWEEN, lower=True)
    texts = len(offs) - 1
    score, which = np.zeros(texts), np.full(texts, -1)
    later: list[dict[tuple[int, int], dict]] = [{} for _ in range(texts)]
    if not len(words):
        return score, which, [[] for _ in range(texts)]
    for segment in _segments(data, words):
        key = words.hash ^ (segment.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        term, part = templates.term_of(words.hash[first]), segment[first]
        known = term >= 0
        count = int(segment[-1]) + 1
        own = np.bincount(part[known], (times[known] * templates.idf[term[known]]) ** 2, minlength=count)
        rest = np.bincount(part[~known], times[~known].astype(float) ** 2, minlength=count)  # a term of all files weighs 1
        norm = np.sqrt(own + rest)
        # Only segments of which template terms make up enough can reach the cosine.
        known &= (np.sqrt(own) >= (least - SLACK) * norm)[part]
        if not known.any():
            continue
        live, row = np.unique(part[known], return_inverse=True)
        weight, at = times[known] * templates.idf[term[known]], term[known]
        dot, top = np.zeros(len(live)), np.full(len(live), -1)
        for i, unit in enumerate(templates.units):
            found = np.bincount(row, weight * unit[at], minlength=len(live))
            top[found > dot] = i
            dot = np.maximum(dot, found)
        most = dot / norm[live]
        doc = words.doc[np.searchsorted(segment, live)]
        value = np.round(most, 9)
        sure = np.flatnonzero((rest[live] == 0) & (top >= 0))
        for i in sure[np.lexsort((top[sure], -value[sure]))]:
            if value[i] > score[doc[i]] or value[i] == score[doc[i]] and top[i] < which[doc[i]]:
                score[doc[i]], which[doc[i]] = value[i], top[i]
        maybe = np.flatnonzero((rest[live] > 0) & (most >= least - SLACK) & (most >= score[doc] - SLACK))
        if not len(maybe):
            continue
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], live[maybe], "right")
        for i, lo, hi in zip(maybe, np.searchsorted(part[order], live[maybe]), ends, strict=True):
            of = order[lo:hi]
            hashes, n = words.hash[first[of]], times[of]
            name = tuple(int((mix(hashes, salt) * n.astype(np.uint64)).sum(dtype=np.uint64).view(np.int64)) for salt in (1, 2))
            other = term[of] < 0
            later[doc[i]][name] = {
                "seg": name[0], "seg2": name[1], "dot": dot[i], "top": top[i], "own": own[live[i]],
                "terms": hashes[other].view(np.int64), "times": n[other],
            }
    return score, which, [list(x.values()) for x in later]


def _frequencies(files: DataFrame) -> DataFrame:
    """(term, n): files that hold each term, by its hash; the number of files has no term."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        return terms, np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(terms)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, files = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for batch in batches:
            files += batch.num_rows
            for _, data, offs in chunks(batch):
                words = Words(data, offs, BETWEEN, lower=True)
                _, first = np.unique(words.hash ^ mix(words.doc.astype(np.uint64)), return_index=True)
                parts.append(np.unique(words.hash[first], return_counts=True))
                if sum(len(t) for t, _ in parts) > TERMS:
                    parts = [summed(parts)]
                    if len(parts[0][0]) > TERMS // 2:
                        yield pa.RecordBatch.from_arrays([signed(parts[0][0]), pa.array(parts[0][1])], ["term", "n"])
                        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        terms, n = summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array([*terms.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n, files))], ["term", "n"])

    return files.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _norms(open_: DataFrame, frequencies: DataFrame, files: int) -> DataFrame:
    """(seg, seg2, norm) of open candidates, from the frequencies of all their words; equal ones count once."""
    once = open_.select("seg", "seg2", "own", "terms", "times").dropDuplicates(["seg", "seg2"])
    words = once.select("seg", "seg2", "own", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("seg", "seg2", "own", F.col("x.terms").alias("term"), F.col("x.times").alias("times"))
    weighed = skew_join(words, frequencies.filter("term is not null"), ["term"], "left")
    idf = F.log(F.lit(files + 1.0) / (F.coalesce("n", F.lit(0)) + 1)) + 1
    return weighed.groupBy("seg", "seg2").agg(F.sqrt(F.max("own") + F.sum((F.col("times") * idf) ** 2)).alias("norm"))


def parent(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(
    files: DataFrame, path_col: str = "path", text_col: str = "text", licence_name: str = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$",
    templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = 0.8, keep: Sequence[str] = (),
) -> DataFrame:
    """One row per file: the columns ``keep``, ``path``, ``license``, ``how`` (own, inherited or null) and ``cosine``."""
    prepare(files.sparkSession)
    own_names, keep = list(keep), [f"_llm_keep_{i}" for i in range(len(keep))]
    slim = files.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(own_names, keep, strict=True)), F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = Templates(templates)
    frequencies = stage_table(_frequencies(slim), "terms")
    numbers = known.terms.view(np.int64).tolist()
    counted = {r["term"]: r["n"] for r in frequencies.filter(F.col("term").isin(numbers) | F.col("term").isNull()).collect()}
    total = counted.get(None, 0)
    known.weigh(np.array([counted.get(i, 0) for i in numbers], float), total)
    shared = files.sparkSession.sparkContext.broadcast(known)
    candidate = pa.struct([("seg", pa.int64()), ("seg2", pa.int64()), ("dot", pa.float64()), ("top", pa.int32()), ("own", pa.float64()), ("terms", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in chunks(batch):
                score, which, later = best_templates(data, offs, shared.value, least)
                kept = [batch.column(c).slice(rows.start, rows.stop - rows.start) for c in (*keep, "path")]
                found = [pa.array(score), pa.array(which.astype(np.int32)), pa.array([x or None for x in later], pa.list_(candidate))]
                yield pa.RecordBatch.from_arrays([*kept, *found], [*keep, "path", "score", "which", "later"])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keep, "path"))
    later = "array<struct<seg long, seg2 long, dot double, top int, own double, terms array<long>, times array<long>>>"
    scanned = slim.mapInArrow(run, f"{schema}, score double, which int, later {later}").withColumn("_llm_row", F.monotonically_increasing_id())
    scanned = stage_table(scanned, "candidates")

    best = ["score", "which"]
    names = F.array(*(F.lit(n) for n in known.names))
    unsure = scanned.filter("later is not null").select("_llm_row", F.explode("later").alias("x")).select("_llm_row", "x.*")
    unsure = skew_join(unsure.select("_llm_row", "seg", "seg2", "dot", "top"), _norms(unsure, frequencies, total), ["seg", "seg2"])
    unsure = unsure.withColumn("value", F.round(F.col("dot") / F.col("norm"), 9)).groupBy("_llm_row").agg(F.max(F.struct("value", (-F.col("top")).alias("before"))).alias("x"))
    both = skew_join(scanned.filter("later is not null").drop("later"), unsure, ["_llm_row"])
    first = F.greatest(F.struct(F.col("score").alias("value"), (-F.col("which")).alias("before")), F.col("x"))
    both = both.withColumn("x", first).withColumns({"score": F.col("x.value"), "which": -F.col("x.before")})
    found = scanned.filter("later is null").select(*keep, "path", *best).unionByName(both.select(*keep, "path", *best))
    good = (F.col("which") >= 0) & (F.col("score") >= least)
    found = found.select(*keep, "path", F.when(good, F.get(names, F.col("which"))).alias("own"), F.when(good, F.col("score")).alias("cosine"))
    found = stage_table(found.withColumn("dir", parent(F.col("path"))), "licenses")

    sources = found.filter(F.col("own").isNotNull() & F.col("path").rlike(licence_name)).groupBy("dir").agg(F.min_by("own", "path").alias("given"))
    dirs = found.filter("own is null and dir is not null").select("dir").distinct()
    names = F.split("dir", "/")
    depths = F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(names)))
    above = dirs.withColumn("depth", F.explode(depths)).withColumn("up", F.array_join(F.slice(names, 1, F.col("depth")), "/"))
    nearest = skew_join(above.withColumnRenamed("dir", "from"), sources.withColumnRenamed("dir", "up"), ["up"]).groupBy("from").agg(F.max_by("given", "depth").alias("given"))
    out = skew_join(found, nearest.withColumnRenamed("from", "dir"), ["dir"], "left")
    how = F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited")
    results = ["path", "license", "how", "cosine"]
    kept = [F.col(k).alias(f"{c}_kept" if c in results else c) for c, k in zip(own_names, keep, strict=True)]
    return out.select(*kept, "path", F.coalesce("own", "given").alias("license"), how.alias("how"), "cosine")
