"""Divergence of the term distributions of sources within a language, in exact integers.

1. An Arrow compute pipeline inside ``mapInArrow``: ``ascii_lower``,
   ``split_pattern_regex``, ``dictionary_encode`` and a hash ``group_by`` turn a batch of texts
   into partial counts per (lang, source, term): occurrences and documents.
   A task merges the counts of its batches before it hands them on, at most ``HELD`` rows at a time.
2. Spark sums the partial counts.  A language keeps the terms of at least ``min_docs``
   of its documents.
3. The kept counts are dealt into columnar shards of about ``SHARD_ROWS`` rows by (lang, hash
   of the term); all counts of a term are in one shard.  Every shard meets the totals of
   its language's sources, one row each.
4. A shard turns counts into ``p = 1 + floor(scale * (count + 1) / (total + kept terms))`` for
   all its terms and the sources of the language, and returns for every
   pair of sources its share of the sum of ``floor((p - q)**2 / q)``, and the terms that
   may be among the ``top`` of a source against the whole language.  Spark adds the
   shares up and ranks.

A hot term is one row per source after the sums, a hot source or language is spread over
its shards, and only partial sums and at most ``top`` terms of a source leave a shard.  A
shard holds its rows and one row and one column for each source of its language; the result
has the same number of pairs.  Terms cost ``sources**2`` divisions each, in blocks of ``BLOCK`` cells.

Edge cases: null text, lang and source are ''; every row counts as a document, repeated ones too; a
(lang, source) without terms is a group like any other, and a language without kept
terms has values of 0; equal values rank by the item's UTF-8 bytes; a language with one source
has no pairs; other columns are not looked at; an empty table returns none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import prepare, stage_table

#: Partial counts that a task merges before it hands them on.
HELD = 1 << 18
SHARD_ROWS = 1 << 17
#: Cells (terms x sources) that a shard works on at once.
BLOCK = 1 << 20
#: Text bytes that one Arrow step takes.
STEP_BYTES = 8 << 20
#: What separates terms: every ASCII character that is no letter.
SEPARATOR = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
KEYS = ["lang", "source", "term"]


def term_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of some rows; the term '' is one row for each (lang, source), with no counts."""
    terms = pc.split_pattern_regex(pc.ascii_lower(text), SEPARATOR)
    row, flat = pc.list_parent_indices(terms), terms.flatten()
    held = pc.not_equal(flat, "")
    row, coded = row.filter(held), flat.filter(held).dictionary_encode()
    each = pa.table({"row": row, "code": coded.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    groups = pa.table({"lang": lang, "source": source})
    seen = pa.table({"lang": lang.take(each["row"]), "source": source.take(each["row"]), "code": each["code"], "n": each["count_all"]})
    found = seen.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    counts = pa.table([found["lang"], found["source"], pc.take(coded.dictionary, found["code"]), found["n_sum"], found["count_all"]], names=[*KEYS, "n", "docs"])
    groups = groups.group_by(["lang", "source"]).aggregate([])
    zero = pa.array(np.zeros(len(groups), np.int64))
    return pa.concat_tables([counts, pa.table([groups["lang"], groups["source"], pa.array([""] * len(groups), pa.string()), zero, zero], names=[*KEYS, "n", "docs"])])


def _merged(parts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select([*KEYS, "n_sum", "docs_sum"]).rename_columns([*KEYS, "n", "docs"])


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about STEP_BYTES of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + STEP_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all rows of ``docs(lang, source, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, floor = [], 0, HELD
        for batch in batches:
            for step in _steps(batch):
                parts.append(term_counts(step.column("lang"), step.column("source"), step.column("text")))
                rows += parts[-1].num_rows
                if rows > 2 * floor:
                    parts = [_merged(parts)]
                    rows = parts[0].num_rows
                    if rows > floor:  # what does not merge into less goes on to Spark's sums
                        yield from parts[0].combine_chunks().to_batches(max_chunksize=HELD)
                        parts, rows = [], 0
        if parts:
            yield from _merged(parts).combine_chunks().to_batches(max_chunksize=HELD)

    partial = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray | int, kept: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + 1) / (total + kept)), exact for counts of any size."""
    if int(count.max(initial=0)) + 1 >= (1 << 62) // scale:
        count = count.astype(object)
    return (1 + scale * (count + 1) // (total + kept)).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q)."""
    return (p - q) ** 2 // q


def _shard(counts: pa.Table, totals: pa.Table, scale: int, top: int) -> pa.Table:
    """Shares of all pairs and the best terms of every source, of one shard of one language."""
    lang = totals["lang"][0].as_py()
    sources = totals["source"].to_pylist()
    total, kept = totals["total"].to_numpy(), int(totals["kept"][0].as_py())
    lang_total, size = int(totals["lang_total"][0].as_py()), len(sources)
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

    def add(source: str, part: str, items: list[str], values: list[int]) -> None:
        out["source"] += [source] * len(items)
        out["part"] += [part] * len(items)
        out["item"] += items
        out["value"] += values

    sums = np.zeros((size, size), np.int64)
    if counts.num_rows:
        coded = counts["term"].combine_chunks().dictionary_encode()
        term, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        place = {s: i for i, s in enumerate(sources)}
        source = np.array([place[s] for s in counts["source"].to_pylist()], np.int64)
        n = counts["n"].to_numpy()
        whole = np.zeros(len(names), np.int64)
        whole[term] = counts["lang_n"].to_numpy()
        # Pairs: blocks of terms as a matrix over all sources, where a missing count is 0.
        order = np.argsort(term, kind="stable")
        step = max(1, BLOCK // size)
        for lo in range(0, len(names), step):
            hi = min(lo + step, len(names))
            a, b = np.searchsorted(term[order], [lo, hi])
            at = order[a:b]
            block = np.zeros((size, hi - lo), np.int64)
            block[source[at], term[at] - lo] = n[at]
            p = shares(block, total[:, None], kept, scale)
            for j in range(size):
                sums[:, j] += divergence(p, p[j]).sum(axis=1)
        # Terms: every count against the whole language; the best of each source.
        p, q = shares(n, total[source], kept, scale), shares(whole, lang_total, kept, scale)[term]
        value = np.where(p > q, divergence(p, q), -1)
        for j in range(size):
            mine = np.flatnonzero((source == j) & (value >= 0))
            if len(mine) > top:
                least = np.partition(value[mine], len(mine) - top)[len(mine) - top]
                mine = mine[value[mine] >= least]  # with ties: the order among them is by bytes
                spell = names.take(pa.array(term[mine])).cast(pa.binary()).to_pylist()
                mine = mine[sorted(range(len(mine)), key=lambda i, m=mine, w=spell: (-value[m[i]], w[i]))[:top]]
            add(sources[j], "term", names.take(pa.array(term[mine])).to_pylist(), value[mine].tolist())
    for i in range(size):
        others = [j for j in range(size) if j != i]
        add(sources[i], "pair", [sources[j] for j in others], sums[i, others].tolist())
    made = pa.table({k: pa.array(v, pa.int64() if k == "value" else pa.string()) for k, v in out.items()})
    return made.add_column(0, "lang", pa.array([lang] * made.num_rows, pa.string()))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_docs: int = 3, top: int = 200, scale: int = 1_000_000_000, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows against every other source, ``term`` rows of the top terms."""
    prepare(docs.sparkSession)
    slim = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = stage_table(count_terms(slim), "term-counts")
    # All counts of a term, one a source, are one window.
    over = Window.partitionBy("lang", "term")
    kept = counts.filter("term <> ''").select(
        *KEYS, "n", F.sum("docs").over(over).alias("in_docs"), F.sum("n").over(over).alias("lang_n"), F.row_number().over(over.orderBy("source")).alias("turn")
    )
    kept = stage_table(kept.filter(F.col("in_docs") >= min_docs).drop("in_docs"), "kept-terms")

    found = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("turn") == 1, 1).otherwise(0)).alias("new"))
    totals = counts.filter("term = ''").select("lang", "source").join(found, ["lang", "source"], "left").fillna(0)
    of_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("new").alias("kept"), F.sum("rows").alias("lang_rows"), F.count(F.lit(1)).alias("sources"))
    # A shard is never smaller than the pairs that it returns.
    size = F.greatest(F.lit(shard_rows), F.col("sources") * F.col("sources"))
    of_lang = of_lang.select("lang", "lang_total", "kept", F.greatest(F.lit(1), F.ceil(F.col("lang_rows") / size)).cast("int").alias("shards"))
    of_lang = stage_table(of_lang, "languages")
    totals = totals.join(of_lang, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rows = kept.join(of_lang.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _shard(left, right, scale, top)

    schema = "lang string, source string, part string, item string, value long"
    left = rows.select("lang", "shard", "source", "term", "n", "lang_n").groupBy("lang", "shard")
    right = totals.select("lang", "shard", "source", "total", "kept", "lang_total").groupBy("lang", "shard")
    parts = stage_table(left.cogroup(right).applyInArrow(run, schema), "divergence-parts")

    names = ["lang", "source", "part", "item", "value"]
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(ranked).alias("rank")
    pairs = parts.filter("part = 'pair'").groupBy(*names[:-1]).agg(F.sum("value").alias("value")).select(*names, rank)
    terms = parts.filter("part = 'term'").select(*names, rank).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
