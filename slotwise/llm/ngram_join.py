"""N-gram Jaccard self-join with adaptive multi-match prefixes, down to connected components.

A document's set holds its distinct word n-grams (a shorter text: its whole word
sequence; no words: empty, linked with nothing).  Documents link if
``100 * intersection >= percent * union``.

1. One pass gives set sizes, set signatures and a sketch of n-gram frequencies
   (``SLOTS`` counters over all texts, so of fixed size).  Documents with equal
   sets form a class; only its smallest id goes on.
2. N-grams are ordered rare first by that sketch.  A set of ``n`` whose partners
   must share ``t`` n-grams and which asks for ``l`` common prefix n-grams posts its first
   ``n - t + l``.  ``l`` is one and one more for every ``STEP`` n-grams of the set, and
   grows with the candidates that the frequencies of the prefix let expect; a
   pair needs ``min(l, l')`` shared prefix n-grams, so no link is lost whatever
   the estimates.
3. Documents that post one n-gram and lie in one size band, or in neighbouring
   ones, meet at the smallest of their ids.  A document that meets others in a
   band by fewer n-grams than any partner could ask for leaves it.
4. Every meeting first compares its documents with one of them, the one that shares
   most, in hashed blocks of about ``BLOCK``: work linear in the meeting, and enough
   for most copies.  Star contraction joins the links found.
5. Only documents that are then not in the component of their meeting's centre are
   compared with the others of the meeting, two blocks at a time: shared prefix
   n-grams, then sizes, then the exact intersection.  A task returns a spanning
   forest of the links it finds, never all pairs.  A second star contraction ends
   the work.

Edge cases: null and empty texts have empty sets and stay alone; rows with the
same id count as one document; a component in which no row has an id has a null
component id; repeated rows return one row each; an empty table returns none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import CHUNK_BYTES, KEY, Words, buffers, chunks, known_id, mix, prepare, row_key, run_hash, signed, skew_join, stage_table
from slotwise.llm.components import components

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
PIECES = 16
BLOCK = 256
#: N-grams of a set for which one more shared prefix n-gram is asked for.
STEP = 50
#: Expected candidates of a prefix above which one more shared n-gram is asked for, again at each doubling.
CHEAP = 64
MORE_MATCHES = 8
#: Numbers from here on stand for rows that share an id (ids are smaller).
OWN_NODES = 1 << 61


class Sets:
    """Distinct n-gram hashes of some texts, ordered by text and hash."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, size: int) -> None:
        words = Words(data, offs, lower=True)
        grams, whole = words.grams(size)
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))
        brief = run_hash(words.runs(), words.bounds[short], words.bounds[short + 1], 3)
        doc = np.concatenate([words.doc[: len(grams)][whole], short])
        grams = np.concatenate([grams[whole], brief])
        order = np.argsort(grams)
        order = order[np.argsort(doc[order].astype(np.uint16 if len(offs) < 65536 else np.int64), kind="stable")]
        doc, grams = doc[order], grams[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
        self.doc, self.grams = doc[fresh], grams[fresh]
        self.bounds = np.searchsorted(self.doc, np.arange(len(offs)))
        self.n = np.diff(self.bounds)

    def fold(self, ufunc: np.ufunc, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.n), np.uint64)
        full = self.n > 0
        if full.any():
            out[full] = ufunc.reduceat(values, self.bounds[:-1][full])
        return out


def slot_of(grams: np.ndarray) -> np.ndarray:
    return (mix(grams, 9) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def heat(counts: np.ndarray) -> np.ndarray:
    """Occurrences of each slot beyond what chance collisions explain."""
    usual = float(np.median(counts)) if len(counts) else 0.0
    return np.where(counts > usual + 6 * np.sqrt(usual + 1) + 4, counts - usual, 0.0)


def prefixes(sets: Sets, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram of ``sets`` whether its text posts it, and for each text the shared prefix n-grams it asks for."""
    warm = hot[slot_of(sets.grams)]
    order = np.argsort(64 * sets.doc + np.log2(1 + warm).astype(np.int64), kind="stable")
    need = (percent * sets.n + 99) // 100
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    place -= sets.bounds[:-1][sets.doc]
    base = sets.n - need + 1
    cost = np.bincount(sets.doc, np.where(place < base[sets.doc], warm, 0.0), minlength=len(sets.n))
    more = np.floor(np.log2(np.maximum(1, cost / CHEAP))).astype(np.int64)
    matches = np.minimum(1 + sets.n // STEP + np.minimum(more, MORE_MATCHES), np.maximum(need, 1))
    return place < (base + matches - 1)[sets.doc], matches


def _describe(slim: DataFrame, size: int) -> DataFrame:
    """Rows of kind 0: a document's size and signature; of kind 1: a piece of the task's frequency sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", *KEY, "n", "s1", "s2", "piece", "counts"]
        sketch = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for rows, data, offs in chunks(batch):
                sets = Sets(data, offs, size)
                sketch += np.bincount(slot_of(sets.grams), minlength=SLOTS)
                count = rows.stop - rows.start
                own = [batch.column(c).slice(rows.start, count) for c in ("doc_id", *KEY)]
                s1, s2 = sets.fold(np.add, mix(sets.grams, 1)), sets.fold(np.bitwise_xor, mix(sets.grams, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(count, np.int32)), *own, pa.array(sets.n), signed(s1), signed(s2), pa.nulls(count, pa.int32()), pa.nulls(count, pa.binary())], names
                )
        parts = sketch.reshape(PIECES, -1)
        none = [pa.nulls(PIECES, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(PIECES, np.int32)), *none, pa.array(np.arange(PIECES, dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names)

    return slim.mapInArrow(run, "kind int, doc_id long, key_id long, key_th int, n long, s1 long, s2 long, piece int, counts binary")


def _sketch(described: DataFrame) -> np.ndarray:
    """The tasks' sketches, added in two steps; SLOTS numbers reach the driver, whatever the input."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "counts": [total.tobytes()]})

    parts = described.filter("kind = 1").select("piece", "counts", (F.rand(7) * 32).cast("int").alias("salt"))
    kind = "piece int, counts binary"
    parts = parts.groupBy("piece", "salt").applyInPandas(add, kind).groupBy("piece").applyInPandas(add, kind)
    found = {r["piece"]: np.frombuffer(r["counts"], np.int64) for r in parts.collect()}
    return np.concatenate([found.get(i, np.zeros(SLOTS // PIECES, np.int64)) for i in range(PIECES)])


def _postings(slim: DataFrame, size: int, hot: np.ndarray, percent: int) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast(hot.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key_id").to_numpy()
            for rows, data, offs in chunks(batch):
                sets = Sets(data, offs, size)
                posted, _ = prefixes(sets, shared.value, percent)
                doc = sets.doc[posted]
                yield pa.RecordBatch.from_arrays([signed(sets.grams[posted]), pa.array(keys[rows][doc]), pa.array(sets.n[doc].astype(np.int32))], ["token", "id", "n"])

    return slim.mapInArrow(run, "token long, id long, n int")


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by ``keys``, as many at once as about CHUNK_BYTES of text: the rows, and where each group begins."""
    rest: pa.Table | None = None
    for batch in chain(batches, [None]):
        parts = [x for x in (rest, batch and pa.Table.from_batches([batch])) if x is not None]
        if not parts:
            return
        table = pa.concat_tables(parts).combine_chunks()
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for key in keys:
            values = table[key].to_numpy()
            change |= values[1:] != values[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])
        whole = len(starts) - (1 if batch is None else 2)  # the last group may go on in the next batch
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(table["text"]).fill_null(0).to_numpy(), dtype=np.int64)])[starts]
        lo = 0
        while lo < whole:
            hi = min(whole, max(lo + 1, int(np.searchsorted(ends, ends[lo] + CHUNK_BYTES, "right")) - 1))
            yield table.slice(starts[lo], starts[hi] - starts[lo]), starts[lo : hi + 1] - starts[lo]
            lo = hi
        rest = table.slice(starts[whole]) if batch is not None else None


def _with_centre(size: int, percent: int):  # noqa: ANN202
    """Which documents of a block link with the meeting's centre: its n-grams are looked up, in linear work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hub", "band", "id", "guest"]
        for table, starts in _groups(batches, ["hub", "band", "block"]):
            centre = table["is_centre"].to_numpy()
            sets = Sets(*buffers(table["text"]), size)
            linked = np.zeros(len(centre), bool)
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                grams = sets.grams[sets.bounds[lo] : sets.bounds[hi]]
                doc = sets.doc[sets.bounds[lo] : sets.bounds[hi]] - lo
                for row in np.flatnonzero(centre[lo:hi] & (sets.n[lo:hi] > 0)).tolist():
                    own = sets.grams[sets.bounds[lo + row] : sets.bounds[lo + row + 1]]
                    met = own[np.minimum(np.searchsorted(own, grams), len(own) - 1)] == grams
                    both = np.bincount(doc[met], minlength=hi - lo)
                    linked[lo:hi] |= (both > 0) & (100 * both >= percent * (sets.n[lo:hi] + len(own) - both))
            others = pa.array(~centre)
            yield from table.select(names).append_column("linked", pa.array(linked)).filter(others).combine_chunks().to_batches()

    return run


def _compare(hot, size: int, percent: int):  # noqa: ANN001, ANN202
    """Links between the documents of two blocks, as a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, ["hub", "band", "low", "high"]):
            ids, block, low, high = (table[c].to_numpy() for c in ("id", "block", "low", "high"))
            guest, known = (table[c].to_numpy() for c in ("guest", "known"))
            sets = Sets(*buffers(table["text"]), size)
            posted, matches = prefixes(sets, hot.value, percent)
            found = [np.zeros((2, 0), np.int64)]
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = slice(lo, hi)
                wanted = ~np.logical_and.outer(guest[own], guest[own]) & ~np.logical_and.outer(known[own], known[own])
                if low[lo] != high[lo]:
                    wanted &= block[own, None] != block[None, own]
                at = slice(sets.bounds[lo], sets.bounds[hi])
                links = _linked(sets.n[own], sets.doc[at] - lo, sets.grams[at], posted[at], matches[own], wanted, percent)
                found.append(ids[own][np.stack(_forest(links))])
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _products(doc: np.ndarray, column: np.ndarray, rows: int, width: int = 2048) -> np.ndarray:
    """How many columns each two rows have in common."""
    total = np.zeros((rows, rows), np.float32)
    for lo in range(0, int(column.max()) + 1 if len(column) else 0, width):
        own = (column >= lo) & (column < lo + width)
        some = np.zeros((rows, width), np.float32)
        some[doc[own], column[own] - lo] = 1
        total += some @ some.T
    return total


def _linked(n: np.ndarray, doc: np.ndarray, grams: np.ndarray, posted: np.ndarray, matches: np.ndarray, wanted: np.ndarray, percent: int) -> np.ndarray:
    """Which documents link, of those that ``wanted`` asks for: prefixes, then sizes, then the exact intersection."""
    rows = len(n)
    found = wanted & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])) & (n[:, None] > 0)
    np.fill_diagonal(found, False)
    if not found.any():
        return found
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column = (np.cumsum(times > 1) - 1)[column]
    first = posted & shared
    _, used = np.unique(column[first], return_inverse=True)
    found &= _products(doc[first], used, rows) >= np.minimum(matches[:, None], matches[None, :])
    live = np.flatnonzero(found.any(axis=1))
    if not len(live):
        return found
    at = np.full(rows, -1)
    at[live] = np.arange(len(live))
    own = shared & (at[doc] >= 0)
    both = _products(at[doc[own]], column[own], len(live))
    size = n[live]
    ok = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    found[np.ix_(live, live)] &= ok
    return found


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, right = [], []
    rest = linked.any(axis=1)
    while rest.any():
        root = int(np.argmax(rest))
        rest[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            near = np.flatnonzero(linked[x] & rest)
            rest[near] = False
            left += [x] * len(near)
            right += near.tolist()
            todo += near.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def _meetings(met: DataFrame, percent: int) -> DataFrame:
    """(hub, band, id, guest): who meets where.  A band holds its own sets and, as guests, those of the band below.

    Sets of one link lie in one band or in neighbouring ones, so they meet in
    the higher band; guests need not be compared with each other.
    """
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) + F.lit(1e-9)).cast("int")
    placed = met.withColumn("own", own).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    placed = placed.withColumn("guest", F.col("band") > F.col("own"))
    hubs = placed.groupBy("token", "band").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.min("guest").alias("only"))
    hubs = hubs.filter("hub <> top and not only").select("token", "band", "hub")
    members = skew_join(placed, hubs, ["token", "band"]).groupBy("hub", "band", "id", "guest", "n").agg(F.count(F.lit(1)).alias("times"))
    members = stage_table(members, "meetings")
    least = F.floor(F.lit(percent) * F.col("n") / F.lit(100 * STEP)) + 1
    enough = members.groupBy("id", "band", "n").agg(F.sum("times").alias("times")).filter(F.col("times") >= least).select("id", "band", "n")
    return members.join(enough, ["id", "band", "n"]).select("hub", "band", "id", "guest", "times")


def _links(members: DataFrame, texts: DataFrame, same: DataFrame, hot, size: int, percent: int) -> DataFrame:  # noqa: ANN001
    """Links between the documents that meet, enough of them to join every component."""
    meeting = ["hub", "band"]
    block = F.expr("cast(pmod(xxhash64(id, hub), blocks) as int)")
    heads = members.groupBy(*meeting).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"),
        F.count(F.lit(1)).alias("all"),
        F.sum(F.col("guest").cast("int")).alias("guests"),
        F.max(F.struct("times", "id")).alias("most"),
    )
    heads = stage_table(heads.filter("all > 1 and all > guests").select(*meeting, "blocks", F.col("most.id").alias("centre")), "heads")
    live = skew_join(members, heads, meeting)
    # Neither side has a bound, so no broadcast even where one looks small.
    texts = stage_table(texts.hint("merge").join(live.select("id").distinct(), "id"), "member-texts")

    own = live.filter("id <> centre").select(*meeting, block.alias("block"), "id", "guest", F.lit(False).alias("is_centre"))
    centres = heads.select(*meeting, F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.col("centre").alias("id"))
    centres = centres.withColumns({"guest": F.lit(False), "is_centre": F.lit(True)})
    first = own.unionByName(centres).hint("merge").join(texts, "id").repartition(*meeting, "block").sortWithinPartitions(*meeting, "block")
    first = first.mapInArrow(_with_centre(size, percent), "hub long, band int, id long, guest boolean, linked boolean")
    first = first.groupBy(*meeting, "id", "guest").agg(F.max("linked").alias("linked"))
    first = stage_table(skew_join(first, heads.select(*meeting, "centre"), meeting), "first-links")
    near = first.filter("linked").select(F.col("id").alias("a"), F.col("centre").alias("b")).unionByName(same)

    groups = components(near)
    placed = first.join(groups.select(F.col("node").alias("id"), F.col("component").alias("own")), "id", "left")
    placed = placed.join(groups.select(F.col("node").alias("centre"), F.col("component").alias("middle")), "centre", "left")
    known = F.coalesce("own", "id") == F.coalesce("middle", "centre")
    placed = stage_table(placed.select(*meeting, "id", "guest", known.alias("known")), "placed")
    counts = placed.groupBy(*meeting).agg(*(F.ceil(F.sum((F.col("known") == k).cast("int")) / F.lit(BLOCK)).cast("int").alias(n) for k, n in ((False, "open"), (True, "done"))))
    rest = skew_join(placed, stage_table(counts.filter("open > 0"), "open"), meeting)
    # Blocks of open documents come first and meet every block; those of known ones meet open blocks only.
    mine = F.expr("cast(pmod(xxhash64(id, hub), if(known, done, open)) as int) + if(known, open, 0)")
    rest = rest.withColumn("block", mine).withColumn("other", F.explode(F.expr("sequence(0, if(known, open, open + done) - 1)")))
    rest = rest.select(*meeting, "id", "guest", "known", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    far = rest.hint("merge").join(texts, "id").repartition(*meeting, "low", "high").sortWithinPartitions(*meeting, "low", "high")
    far = far.mapInArrow(_compare(hot, size, percent), "a long, b long")
    return near.unionByName(far)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id``, key columns, ``n_shingles`` and ``component_id``.

    ``size`` is the words of an n-gram; two documents link from ``percent`` percent
    Jaccard similarity on.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    described = stage_table(_describe(slim, size), "sets")
    hot = heat(_sketch(described))

    nodes = described.filter("kind = 0").select("doc_id", *KEY, "n", "s1", "s2")
    full = nodes.filter("n > 0")
    classes = full.groupBy("n", "s1", "s2").agg(F.min("key_id").alias("rep"), F.max("key_id").alias("top")).filter("rep <> top")
    # An id with several sets stays a document of its own and is linked with its copies instead.
    several = full.groupBy("key_id").agg((F.min(F.struct("n", "s1", "s2")) != F.max(F.struct("n", "s1", "s2"))).alias("several"))
    copies = skew_join(full, classes, ["n", "s1", "s2"]).filter("key_id <> rep").select("key_id", "rep").distinct().join(several, "key_id")
    copies = stage_table(copies.select(F.col("key_id").alias("id"), "rep", "several"), "copies")
    same, copies = copies.filter("several").select(F.col("id").alias("a"), F.col("rep").alias("b")), copies.filter("not several").select("id", "rep")

    postings = _postings(slim, size, hot, percent)
    common = postings.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("token")
    met = stage_table(skew_join(postings, common, ["token"]), "postings").join(copies.select("id"), "id", "left_anti")
    members = stage_table(_meetings(met, percent), "members")
    shared = docs.sparkSession.sparkContext.broadcast(hot.astype(np.float32))
    links = _links(members, slim.select(F.col("key_id").alias("id"), "text"), same, shared, size, percent)
    groups = components(links)

    named = nodes.join(copies, nodes["key_id"] == copies["id"], "left").drop("id").withColumn("rep", F.coalesce("rep", "key_id"))
    named = named.join(groups, named["rep"] == groups["node"], "left")
    return named.select("doc_id", *KEY, F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_key")).withColumn(
        "component_id", known_id(F.col("component_key"))
    )


def _row_nodes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a node number, ``_llm_node``, and (node, own): the ids behind numbers that are no ids.

    A row's node is its id key.  Unlike texts that share an id get numbers of their own from
    ``OWN_NODES`` on, which a written table fixes.
    """
    key, _ = row_key(id_col, text_col)
    marked = docs.withColumns({"_llm_node": key, "_llm_th": F.xxhash64(F.col(f"`{text_col}`").cast("string"))})
    unlike = marked.groupBy("_llm_node").agg(F.min("_llm_th").alias("lo"), F.max("_llm_th").alias("hi")).filter("lo <> hi").select("_llm_node")
    rows = skew_join(marked.select("_llm_node", "_llm_th"), unlike, ["_llm_node"], "left_semi").distinct()
    own = stage_table(rows.withColumn("_llm_own", F.lit(OWN_NODES) + F.monotonically_increasing_id()), "row-nodes")
    named = own.select(F.col("_llm_own").alias("node"), F.col("_llm_node").alias("own"))
    if not own.isEmpty():
        marked = skew_join(marked, own, ["_llm_node", "_llm_th"], "left").withColumn("_llm_node", F.coalesce("_llm_own", "_llm_node"))
    return marked.select(*docs.columns, "_llm_node"), named


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id.

    Rows with one id and unlike texts are documents of their own: each stays unless it
    is a near copy of a row that does.  Of equal rows one stays, and so does one of the rows
    without an id and without text.
    """
    marked, named = _row_nodes(docs, id_col, text_col)
    found = ngram_components(marked.select("_llm_node", F.col(f"`{text_col}`").alias("_llm_text")), "_llm_node", "_llm_text", size, percent)
    found = found.select(F.col("doc_id").alias("node"), "component_key").join(named, "node", "left")
    first = found.groupBy("component_key").agg(F.min(F.struct(F.coalesce("own", "node").alias("id"), "node")).alias("first"))
    kept = marked.join(first.select(F.col("first.node").alias("_llm_node")), "_llm_node", "left_semi")
    return kept.dropDuplicates(["_llm_node"]).select(*docs.columns)
