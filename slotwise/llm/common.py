"""Shared helpers: scratch tables, row keys and vectorised word hashing.

Word hashing works on the UTF-8 buffers of an Arrow batch, in slices of bounded
size, so a task holds a few arrays per slice whatever the partition holds.
Hashes are 64-bit and scramble every 8-byte block and every step of a run, so that
unequal words or runs collide by chance only, whatever their pattern.  Where a whole
table's runs are compared, operators use two such hashes of unlike runs together.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step takes (a longer single text is one step).
CHUNK_BYTES = 1 << 20

#: Rows of an Arrow batch sent to a Python worker.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless the user has set them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="slotwise-llm-"))
    return f"{shared.rstrip('/')}/slotwise/{spark.sparkContext.applicationId}"


_LOCAL: dict[str, str] = {}


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys from here on stand for rows without an id.
NO_ID = 1 << 62


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two non-null columns that tell rows apart: the id and a text hash.

    A row without an id gets a number from NO_ID on, made from its text.  Rows
    equal in both columns are equal in id and text, so they get equal results.
    """
    without = F.lit(NO_ID) + F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(NO_ID - 1))
    return [
        F.coalesce(F.col(id_col).cast("long"), without).alias("key_id"),
        F.hash(F.col(text_col), F.col(id_col)).alias("key_th"),
    ]


KEY = ["key_id", "key_th"]


def known_id(key: Column) -> Column:
    """The id behind a key, null for a row without one."""
    return F.when(key < F.lit(NO_ID), key)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` such that Spark can split a key that holds many rows.

    Adaptive execution splits a skewed join only where both sides come straight from
    a shuffle that it placed.  One more key, a hash of the others, makes it place them
    even where a side was grouped by the same keys before.
    """
    both = ["_llm_key", *keys]
    left, right = (df.withColumn("_llm_key", F.xxhash64(*keys)) for df in (left, right))
    return left.join(right, both, how).drop("_llm_key")


# ---------------------------------------------------------------- bytes and words


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Separators of the word class ``[^\x20\x09-\x0D]+``.
SPACE = byte_table((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLE = np.uint64(0x9E3779B97F4A7C15)
_LEFT = np.uint64(0xD1342543DE82EF95)
#: Masks that keep the first 0 to 8 bytes of a little-endian block.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of a batch of about CHUNK_BYTES of text: (rows, bytes, offsets)."""
    data, offs = buffers(batch.column(column))
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1)
        yield slice(lo, hi), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of some texts: byte starts and ends, 64-bit hashes, and the range of words of each text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE, lower: bool = False) -> None:
        self.data = LOWER[data] if lower else data
        self.offs = offs
        gap = sep[self.data]
        n = len(gap)
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        edge = offs[(offs > 0) & (offs < n)]
        before[edge], after[edge - 1] = True, True
        self.starts = np.flatnonzero(~gap & before)
        self.ends = np.flatnonzero(~gap & after) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.counts)
        self._blocks: np.ndarray | None = None
        self.hash = self.hashes(self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of more than ``size`` bytes, and the hashes of their first ``size`` bytes."""
        longer = np.flatnonzero(self.ends - self.starts > size)
        return longer, self.hashes(np.minimum(self.ends, self.starts + size))[longer]

    def hashes(self, ends: np.ndarray) -> np.ndarray:
        """Hash of each word up to ``ends``: its 8-byte blocks, scrambled with their places and summed, and its length.

        Words of up to 8 bytes and of one length never collide.
        """
        if self._blocks is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._blocks = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        size = ends - self.starts
        out = mix(self._blocks[self.starts] & _MASK[np.minimum(size, 8)])
        rows = np.flatnonzero(size > 8)
        if len(rows):
            more = (size[rows] - 1) // 8
            before = np.cumsum(more) - more
            one = np.repeat(rows, more)
            turn = np.arange(len(one)) - np.repeat(before, more) + 1
            at = self.starts[one] + 8 * turn
            block = mix(self._blocks[at] & _MASK[np.minimum(ends[one] - at, 8)], 11)
            out[rows] += np.add.reduceat(mix(block + mix(turn.astype(np.uint64), 12)), before)
        return mix(out + size.astype(np.uint64) * _MULTIPLE)

    def runs(self) -> Runs:
        """What ``run_hash`` takes the hash of any run of words from."""
        return Runs(self.hash)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every k-word window that starts at a word, and whether it ends in the same text."""
        first = np.arange(max(0, len(self) - k + 1))
        whole = first + k <= self.bounds[1:][self.doc[first]]
        return run_hash(self.runs(), first, first + k), whole


class Runs:
    """Hashes of all runs of 1, 2, 4, ... words, made when first asked for.

    A run of any length is named by the two runs of a power of two that cover it.
    Every step scrambles, so no sequence of words collides for its pattern alone.
    """

    def __init__(self, hashes: np.ndarray) -> None:
        self.levels = [hashes]

    def level(self, number: int) -> np.ndarray:
        while len(self.levels) <= number:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(mix(last[:-half] * _LEFT + last[half:], 30 + len(self.levels)))
        return self.levels[number]


def run_hash(runs: Runs, first: np.ndarray, last: np.ndarray, salt: int = 1) -> np.ndarray:
    """Hash of the words first..last-1, equal for equal word sequences wherever they stand; 0 for no words."""
    size = np.asarray(last - first)
    out = np.zeros(len(size), np.uint64)
    power = np.frexp(size)[1] - 1
    for number in np.unique(power[size > 0]).tolist():
        rows = np.flatnonzero((power == number) & (size > 0))
        level = runs.level(number)
        both = level[first[rows]] * _LEFT + level[last[rows] - (1 << number)]
        out[rows] = mix(both + size[rows].astype(np.uint64) * _MULTIPLE, salt)
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
