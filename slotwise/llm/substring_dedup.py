"""Substring dedup by level-wise doubling: 9, 18, then ``window`` (35) words.

A window of ``window`` words is repeated if its word sequence also starts anywhere
else, in the same text or another.  Words inside repeated windows are removed.

(A window of fewer than 26 words starts with shorter seeds.)

Level 9: among the ``window - 8`` nine-word runs inside a window, the one with the
smallest hash (the leftmost of equals) is its seed, so equal windows have equal
seeds at equal places, and about one word in fourteen starts a seed.  Windows in
a row with one seed form a run, which is one row.  Runs whose seed occurs once are
dropped; the others go on.

Runs that occur twice as a whole need no further look: all their windows are
repeated.  What is left are the runs at the edges of repeated passages, and the
runs that share a seed with them.

Level 18: their seeds are extended to twice the length, to the left and to the
right; a window holds at least one of the two.  Where an extension occurs only
once, the windows that hold it are dropped.

Last level: the windows left are compared at full length.  ``remove_repeats`` ends
here, as longer repeats change nothing about the words to remove; ``repeat_levels``
goes on to twice the length, and so on until no candidates survive.

Counts are grouped sums over all texts with partial sums in each task, so a
passage shared by a third of all texts is as cheap as any other; joins are by
hash and may be split by Spark where skewed.  A collected list never exceeds one
text.  Hashes are 64-bit, and windows are compared by seed and window hash together.
Rows equal in id and text share one set of spans.

Edge cases: a null or empty text has no words, nothing removed and an empty kept
text; texts shorter than a window are kept whole; rows that are equal in id and
text are repeats of each other; repeated or null ids are told apart by their
text; an empty table returns none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import KEY, Words, chunks, prepare, row_key, run_hash, signed, skew_join, stage_table

HIDDEN = [f"_llm_{k}" for k in KEY]


def seed_size(window: int) -> int:
    """Words of a seed: 9, or fewer such that every window holds the seed's extension to one side."""
    return min(9, (window + 1) // 3)


def _leftmost_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of the leftmost smallest one."""
    at, done = np.arange(len(values)), 1
    while 2 * done <= width:
        left, right = at[:-done], at[done:]
        at = np.where(values[right] < values[left], right, left)
        done *= 2
    if done < width:
        left, right = at[: len(at) - (width - done)], at[width - done :]
        at = np.where(values[right] < values[left], right, left)
    return at


def _runs(words: Words, window: int) -> dict[str, np.ndarray] | None:
    """Windows in a row with one seed: text, first window, windows, place of the seed, and hashes."""
    count = len(words) - window + 1
    if count <= 0:
        return None
    seed = seed_size(window)
    seeds, _ = words.grams(seed)
    ends = words.bounds[1:][words.doc]
    first = np.arange(count)
    first = first[first + window <= ends[first]]
    if not len(first):
        return None
    place = _leftmost_smallest(seeds, window - seed + 1)[first]
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(first)))
    a, at = first[begin], place[begin]
    doc = words.doc[a]
    total = words.runs()
    left, right = at - seed, at + 2 * seed
    has_left, has_right = left >= words.bounds[doc], right <= words.bounds[doc + 1]
    return {
        "doc": doc,
        "first": a - words.bounds[doc],
        "size": size,
        "at": at - a,
        "seed": seeds[at],
        "run": run_hash(total, a, a + size - 1 + window, 5),
        "left": np.where(has_left, run_hash(total, np.where(has_left, left, at), np.where(has_left, at + seed, at), 6), 0),
        "right": np.where(has_right, run_hash(total, at, np.where(has_right, right, at), 7), 0),
        "has_left": has_left,
        "has_right": has_right,
    }


def _half(hashes: np.ndarray, known: np.ndarray) -> pa.Array:
    """The upper half of each hash, null where there is none; 0 is a hash like others."""
    values = (hashes.astype(np.uint64) >> np.uint64(32)).astype(np.uint32)
    return pa.array(values.view(np.int32), mask=~known)


def _find_runs(slim: DataFrame, window: int, columns: str) -> DataFrame:
    """Runs of all texts; ``columns`` of key_id, key_th, first, size, at, seed, run, left, right."""
    names = columns.split()
    kinds = dict.fromkeys(("key_th", "first", "size", "at", "left", "right"), "int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {h: batch.column(h).to_numpy() for h in HIDDEN}
            for rows, data, offs in chunks(batch, "_llm_text"):
                found = _runs(Words(data, offs), window)
                if found is None:
                    continue
                out = []
                for c in names:
                    if c in KEY:
                        out.append(pa.array(keys[f"_llm_{c}"][rows][found["doc"]]))
                    elif c in ("left", "right"):  # half a hash is enough to rule windows out
                        out.append(_half(found[c], found[f"has_{c}"]))
                    elif c in kinds:
                        out.append(pa.array(found[c].astype(np.int32)))
                    else:
                        out.append(signed(found[c]))
                yield pa.RecordBatch.from_arrays(out, names)

    return slim.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def _windows(joined: DataFrame, window: int) -> DataFrame:
    """Full-length hashes of the candidate windows of texts, listed in ``ranges``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(h).to_numpy() for h in HIDDEN]
            ranges = batch.column("ranges")
            for rows, data, offs in chunks(batch, "_llm_text"):
                words = Words(data, offs)
                total = words.runs()
                part = ranges.slice(rows.start, rows.stop - rows.start)
                lists = part.offsets.to_numpy() - part.offsets[0].as_py()
                flat = part.flatten()
                lo, hi, seed, alone = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                doc = np.repeat(np.arange(len(lists) - 1), np.diff(lists))
                size = (hi - lo + 1).astype(np.int64)
                one = np.repeat(np.arange(len(lo)), size)
                start = np.arange(len(one)) - np.repeat(np.cumsum(size) - size, size) + lo[one]
                at = words.bounds[doc[one]] + start
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(k[rows][doc[one]]) for k in keys),
                        pa.array(start.astype(np.int32)),
                        pa.array(seed[one]),
                        signed(run_hash(total, at, at + window, 8)),
                        pa.array(alone[one].astype(bool)),
                    ],
                    [*KEY, "first", "seed", "window", "alone"],
                )

    return joined.mapInArrow(run, "key_id long, key_th int, first int, seed long, window long, alone boolean")


def _repeated_spans(slim: DataFrame, window: int) -> DataFrame:
    """(key_id, key_th, spans): the first word and number of windows of each repeated stretch of a text."""
    seeds = _find_runs(slim, window, "seed").groupBy("seed").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("seed")
    rows = skew_join(_find_runs(slim, window, "key_id key_th first size at seed run left right"), seeds, ["seed"])
    rows = stage_table(rows, "runs")

    sample = F.min(F.struct(*KEY, "first", "size", "at", "left", "right")).alias("one")
    kinds = stage_table(rows.groupBy("seed", "run").agg(F.count(F.lit(1)).alias("times"), sample), "kinds")
    sure = kinds.filter("times > 1").select("seed", "run")
    spans = rows.join(sure, ["seed", "run"]).select(*KEY, "first", "size")

    open_seeds = kinds.filter("times = 1").select("seed").distinct()
    live = stage_table(skew_join(kinds, open_seeds, ["seed"], "left_semi").select("seed", "times", "one.*"), "live")
    for side in ("left", "right"):
        twice = live.filter(F.col(side).isNotNull()).groupBy("seed", side).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        live = skew_join(live, twice.select("seed", side, F.lit(True).alias(f"{side}_twice")), ["seed", side], "left")
    live = live.filter("left_twice or right_twice")
    last = F.col("first") + F.col("size") - 1
    seed, seed_at = seed_size(window), F.col("first") + F.col("at")
    lo = F.when(F.col("left_twice").isNull(), F.greatest(F.col("first"), seed_at - (window - 2 * seed))).otherwise(F.col("first"))
    hi = F.when(F.col("right_twice").isNull(), F.least(last, seed_at - seed)).otherwise(last)
    ranges = live.select(*KEY, lo.alias("lo"), hi.alias("hi"), "seed", (F.col("times") == 1).alias("alone")).filter("lo <= hi")
    ranges = ranges.groupBy(*(F.col(k).alias(h) for k, h in zip(KEY, HIDDEN, strict=True))).agg(F.collect_list(F.struct("lo", "hi", "seed", "alone")).alias("ranges"))
    windows = _windows(slim.join(ranges, HIDDEN), window)
    again = windows.groupBy("seed", "window").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("any")).filter("n > 1 and any").select("seed", "window")
    hits = skew_join(windows.filter("alone"), again, ["seed", "window"]).select(*KEY, "first", F.lit(1).alias("size"))
    both = spans.unionByName(hits)
    return both.groupBy(*(F.col(k).alias(h) for k, h in zip(KEY, HIDDEN, strict=True))).agg(F.collect_set(F.struct("first", "size")).alias("spans"))


def _extendable(spans: DataFrame, window: int) -> DataFrame:
    """Keys of the texts in which one repeated window starts ``window`` words after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own in batch.column("spans"):
                first, size = (own.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
                edge = np.zeros(int((first + size).max()) + window + 1, np.int64)
                np.add.at(edge, first, 1)
                np.subtract.at(edge, first + size, 1)
                starts = np.cumsum(edge) > 0
                found.append(bool((starts[:-window] & starts[window:]).any()))
            yield pa.RecordBatch.from_arrays([batch.column(h) for h in HIDDEN], HIDDEN).filter(pa.array(found, pa.bool_()))

    return spans.mapInArrow(run, f"{HIDDEN[0]} long, {HIDDEN[1]} int")


def repeat_levels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per document: ``doc_id``, key columns and ``level``, the longest repeat found by doubling (0: none).

    Levels go on from ``window`` words to twice that length and so on.  A longer
    window can only be repeated if both its halves are, so just the texts with a
    repeated window right behind another one reach the next level; the loop ends
    when no candidates survive.
    """
    prepare(docs.sparkSession)
    hidden = dict(zip(HIDDEN, row_key(id_col, text_col), strict=True))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_llm_text"), *(c.alias(h) for h, c in hidden.items()))
    left, level, found = slim.select(*HIDDEN, "_llm_text"), window, []
    while True:
        spans = stage_table(_repeated_spans(left, level), "level")
        if spans.isEmpty():
            break
        found.append(spans.select(*HIDDEN, F.lit(level).alias("level")))
        left = stage_table(slim.select(*HIDDEN, "_llm_text").join(_extendable(spans, level).distinct(), HIDDEN, "left_semi"), "candidates")
        level *= 2
    out = slim.select("doc_id", *HIDDEN)
    for part in found:  # the levels of a text are nested, so the last one found counts
        out = out.join(part.withColumnRenamed("level", "_level"), HIDDEN, "left").withColumn("level", F.coalesce("_level", *(["level"] if "level" in out.columns else []), F.lit(0))).drop("_level")
    if not found:
        out = out.withColumn("level", F.lit(0))
    return out.select("doc_id", *(F.col(h).alias(k) for h, k in zip(HIDDEN, KEY, strict=True)), "level")


def _covered(words: Words, part: pa.Array, window: int) -> np.ndarray:
    """Words of some texts that lie in the windows of their ``spans``."""
    edge = np.zeros(len(words) + 1, np.int64)
    lists = part.offsets.to_numpy() - part.offsets[0].as_py()
    flat = part.flatten()
    if len(flat):
        first, size = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        at = words.bounds[np.repeat(np.arange(len(lists) - 1), np.diff(lists))] + first
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + size + window - 1, 1)
    return np.cumsum(edge[:-1]) > 0


def _cut(data: np.ndarray, words: Words, gone: np.ndarray, layout: bool) -> list[str]:
    """Texts without their ``gone`` words: words joined by one space, or the text as it stands around the cuts."""
    out, raw = [], data.tobytes()
    for d in range(len(words.counts)):
        lo, hi = words.bounds[d], words.bounds[d + 1]
        text = raw[words.offs[d] : words.offs[d + 1]]
        drop = gone[lo:hi]
        if not layout:
            own = text.split()
            out.append(b" ".join(own if not drop.any() else [w for w, x in zip(own, drop.tolist(), strict=True) if not x]))
        elif not drop.any():
            out.append(text)
        else:
            edges = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8))).reshape(-1, 2)
            starts = np.append(words.starts[lo:hi] - words.offs[d], len(text))
            keep, at = [], 0
            for a, b in edges.tolist():
                keep.append(text[at : starts[a]])
                at = int(starts[b])
            out.append(b"".join([*keep, text[at:]]))
    return [x.decode() for x in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, layout: bool = False, n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with the text cut down to the words outside repeated windows, and two counts added.

    The kept words are joined by one space; with ``layout`` the text around the
    cuts stays as it is, and a text without repeats unchanged.  ``window`` is at
    least 2; ``n_words`` and ``n_removed`` name the added columns.
    """
    prepare(docs.sparkSession)
    if window < 2:
        raise ValueError("window must be at least 2 words")
    hidden = dict(zip(HIDDEN, row_key(id_col, text_col), strict=True))
    marked = docs.withColumns(hidden | {"_llm_text": F.coalesce(F.col(text_col).cast("string"), F.lit(""))}).drop(text_col)
    slim = marked.select(*HIDDEN, "_llm_text")
    spans = _repeated_spans(slim, window)
    none = F.expr("cast(array() as array<struct<first:int,size:int>>)")
    joined = marked.join(spans.withColumnRenamed("spans", "_llm_spans"), HIDDEN, "left").withColumn("_llm_spans", F.coalesce("_llm_spans", none))
    others = [c for c in docs.columns if c != text_col]
    order = [*docs.columns, n_words, n_removed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in chunks(batch, "_llm_text"):
                words = Words(data, offs)
                gone = _covered(words, batch.column("_llm_spans").slice(rows.start, rows.stop - rows.start), window)
                made = {c: batch.column(c).slice(rows.start, rows.stop - rows.start) for c in others}
                made[text_col] = pa.array(_cut(data, words, gone, layout), pa.string())
                total = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])
                made[n_words] = pa.array(words.counts.astype(np.int64))
                made[n_removed] = pa.array(total[words.bounds[1:]] - total[words.bounds[:-1]])
                yield pa.RecordBatch.from_arrays([made[c] for c in order], order)

    fields = [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())])
    return joined.select(*others, "_llm_text", "_llm_spans").mapInArrow(run, schema)
