"""Small tables for the edge cases that every operator has to stand."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Columns named like those that operators make for themselves.
CLASHES = ["n_words", "key_id", "key_th", "spans", "ranges", "words", "token", "id", "n", "hub", "hit", "rows", "ids", "kept", "label", "host", "x"]


def table(spark: SparkSession, rows: list[tuple], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) rows with other columns beside them, all of them null in every other row."""
    fields = [T.StructField(id_col, T.LongType()), T.StructField(text_col, T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASHES)]
    full = [(i, t, *((f"c{k}" if k % 2 else None) for _ in CLASHES)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, T.StructType(fields))


def sentences(seed: int, count: int, words: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words)) for _ in range(count)]


def edge_rows() -> list[tuple]:
    """Null, empty, blank, short, very long, repeated and near-equal texts, and null and repeated ids."""
    base = sentences(1, 6, 120)
    long = " ".join(sentences(2, 30, 100, 5000))
    near = base[0].replace("w1 ", "w1x ")
    rows = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "one two three four"), (6, "one two three four")]
    rows += [(10 + i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, near), (22, base[1] + "\n" + base[2]), (23, "A" * 3000), (24, "a b " * 400), (25, long), (26, long.upper())]
    rows += [(30, base[3]), (30, base[3]), (31, base[4]), (31, base[5] + " tail"), (None, base[2]), (None, None), (None, "only here " * 30)]
    rows += [(40, "été ça\x1cb c «ß» 日本語 ▁x " * 20), (41, base[0][:300] + " \n\n " + base[0][:300])]
    return rows


def run_duckdb(sql: str, **tables: DataFrame) -> list[tuple]:
    """Rows of a query over Spark tables with the id and text columns only."""
    con = duckdb.connect()
    for name, df in tables.items():
        kinds = ", ".join(f"{f.name} {'BIGINT' if f.dataType.simpleString() == 'bigint' else 'VARCHAR'}" for f in df.schema.fields)
        con.execute(f"CREATE TABLE {name} ({kinds})")
        rows = [tuple(r) for r in df.collect()]
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", rows)
    return con.execute(sql).fetchall()
