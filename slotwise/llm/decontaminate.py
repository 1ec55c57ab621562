"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's words are its runs of letters, digits and non-ASCII characters, with A-Z
lower-cased.  An item's windows are all its runs of ``window`` (13) words; an item
of fewer words is one window.

1. Fingerprints: hashes of k words (k the largest power of two up to the window's
   length, 8 for 13), of which every window keeps the smallest.  Equal windows
   keep equal fingerprints, so any shared span of a window's length is found.
2. Document fingerprints are joined with the benchmark's.  The rows go straight
   into a grouped maximum, so each task sends one row per document.
3. Documents with a hit are read again and the hits extended: every window is
   compared at full length, by the hashes of its first and of its last k words,
   which cover it.

The benchmark's side of a join, and the keys of the documents with a hit, are
broadcast only while they have at most ``BROADCAST_ROWS`` rows; beyond, both sides are
shuffled by hash.

Edge cases: a null or empty text has no words and no hits; an item without words
matches nothing; repeated rows return one row each; null and repeated ids are
told apart by their text; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import KEY, row_key, stage_table

#: A-Z and a-z, and the characters between words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Rows of 24 bytes up to which a join side is broadcast (24 MB).
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def gram_size(length: int) -> int:
    """Largest power of two up to ``length``."""
    return 1 << (length.bit_length() - 1)


def _head(name: str, drop: int) -> Column:
    return F.slice(name, 1, F.greatest(F.size(name) - drop, F.lit(0)))


def _tail(name: str, drop: int) -> Column:
    return F.slice(name, drop + 1, F.greatest(F.size(name) - drop, F.lit(0)))


def _pairwise(name: str, gap: int, combine) -> Column:  # noqa: ANN001
    """combine(x[i], x[i + gap]) for every i that has both."""
    return F.zip_with(_head(name, gap), _tail(name, gap), combine)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def with_grams(df: DataFrame, sizes: set[int]) -> DataFrame:
    """Add ``g1``, ``g2``, ``g4`` ... : hashes of so many words from each word, doubling up to the largest size."""
    df = df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    size = 1
    while size < max(sizes):
        df = df.withColumn(f"g{2 * size}", _pairwise(f"g{size}", size, lambda a, b: F.xxhash64(a, b)))
        size *= 2
    return df


def with_fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``marks``: the distinct winnowed hashes of all windows of the given lengths."""
    df = with_grams(df, {gram_size(x) for x in lengths})
    parts = []
    for length in lengths:
        k = gram_size(length)
        name, width = f"g{k}", 1
        while 2 * width <= length - k + 1:
            df = df.withColumn(f"m{length}_{2 * width}", _pairwise(name, width, _smaller))
            name, width = f"m{length}_{2 * width}", 2 * width
        if width < length - k + 1:
            df = df.withColumn(f"m{length}", _pairwise(name, length - k + 1 - width, _smaller))
            name = f"m{length}"
        parts.append(F.col(name))
    marks = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.withColumn("marks", F.array_distinct(marks))


def _exploded(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per element; a plain explode would push a filter on the whole chain of hashes down to the scan."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def _window(length: int):  # noqa: ANN202
    return lambda p, i: F.struct(i.alias("at"), F.lit(length).alias("length"), p["a"].alias("a"), p["b"].alias("b"))


def windows(df: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """One row per window: the columns ``keep``, its place, its length and two hashes that cover it."""
    df = with_grams(df, {gram_size(x) for x in lengths})
    lists = []
    for length in lengths:
        k = gram_size(length)
        name, gap = f"g{k}", length - k
        pairs = F.zip_with(_head(name, gap), _tail(name, gap), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        lists.append(F.transform(pairs, _window(length)))
    every = lists[0] if len(lists) == 1 else F.concat(*lists)
    return _exploded(df, every, "w", *keep).select(*keep, "w.*")


def _sized(df: DataFrame) -> DataFrame:
    """A join side, to broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def find_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13
) -> DataFrame:
    """One row per document: ``doc_id``, key columns, ``n_words``, ``n_hit``, ``items`` (sorted strings) and ``contaminated``."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text)).alias("words"))
    items = stage_table(items.filter("size(words) > 0").withColumn("length", F.least(F.size("words"), F.lit(window))), "items")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect()) or [window]  # 1 to window

    def per_length(make) -> DataFrame:  # noqa: ANN001
        parts = [make(items.filter(F.col("length") == n), n) for n in lengths]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.distinct()

    marks = stage_table(per_length(lambda df, n: _exploded(with_fingerprints(df, [n]), F.col("marks"), "mark")), "marks")
    targets = stage_table(per_length(lambda df, n: windows(df.drop("length"), [n], "item").drop("at")), "targets")

    slim = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    split = slim.select("doc_id", *KEY, words_of(F.col("text")).alias("words"))
    marked = with_fingerprints(split, lengths).select("doc_id", *KEY, F.size("words").cast("long").alias("n_words"), F.posexplode_outer("marks").alias("at", "mark"))
    joined = marked.join(_sized(marks.withColumn("hit", F.lit(True))), "mark", "left")
    first = (F.col("at").isNull() | (F.col("at") == 0)).cast("int")
    seen = stage_table(joined.groupBy("doc_id", *KEY, "n_words").agg(F.max("hit").alias("hit"), F.sum(first).alias("rows")), "seen")

    # Written once, so that hashing starts from a scan again; repeated rows are as one in the sets below.
    keys = _sized(seen.filter("hit").select(*KEY).distinct())  # few, so that no text is shuffled
    suspects = stage_table(slim.drop("doc_id").join(keys, KEY, "left_semi"), "suspects")
    places = windows(suspects.select(*KEY, words_of(F.col("text")).alias("words")), lengths, *KEY)
    found = places.join(_sized(targets), ["length", "a", "b"]).groupBy(*KEY).agg(
        F.collect_set(F.struct("at", "length")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")
    )
    reach = F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))
    found = found.select(*KEY, "items", F.size(F.array_distinct(F.flatten(reach))).cast("long").alias("n_hit"))
    out = seen.join(found, KEY, "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.expr("cast(array() as array<string>)"))})
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    out = out.withColumn("row", F.explode(F.expr("sequence(1, cast(rows as int))")))
    return out.select("doc_id", *KEY, "n_words", "n_hit", "items", "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = find_hits(docs, benchmark, id_col, text_col, window=window).filter("contaminated").select(*KEY).distinct()
    hidden = {f"_llm_{k}": v for k, v in zip(KEY, row_key(id_col, text_col), strict=True)}
    marked = docs.withColumns(hidden)
    return marked.join(bad, [F.col(f"_llm_{k}") == bad[k] for k in KEY], "left_anti").select(*docs.columns)
