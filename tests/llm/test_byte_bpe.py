"""Byte-level BPE against the tiktoken library, texts and single matches."""

import base64
import hashlib
import random

import cases
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from slotwise.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(open(PATH, "rb").read(), PATTERN)


def test_every_row_as_the_library(spark, library):
    rows = cases.edge_rows() + [(50, "x" * 20_000), (51, "<|endoftext|> it's'll 12345 \r\n\n  ー" * 50), (52, "abcé日" * 5000)]
    df = cases.table(spark, rows)
    coded = byte_bpe.decode(byte_bpe.encode(df, PATH, PATTERN, keep=["doc_id", "text", "n", "token"]), PATH, PATTERN)
    assert coded.columns == ["doc_id", "text", "n", "token", "ids", "decoded"]
    found = coded.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    same = sorted(((r["doc_id"], r["text"], r["n"]) for r in df.collect()), key=str)
    assert sorted(((r["doc_id"], r["text"], r["n"]) for r in found), key=str) == same


def test_empty_table_and_null_ids(spark):
    assert byte_bpe.encode(cases.table(spark, []), PATH, PATTERN).collect() == []
    ids = spark.createDataFrame([(1, [72, 105]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(ids, PATH, PATTERN).collect()}
    assert got[2] == got[3] == b"" and len(got[1]) > 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text(library, encoder, text):
    ids = encoder.encode(text)
    assert ids.tolist() == library.encode_ordinary(text) and encoder.decode(ids) == text.encode()


def test_long_matches_and_ties(library, encoder):
    rng = random.Random(5)
    for alphabet, size in (("a", 5000), ("ab", 5000), ("abcdefghijklmnop", 30_000), ("é日a", 4000)):
        text = "".join(rng.choice(alphabet) for _ in range(size))
        assert list(encoder.match_ids(text.encode())) == library.encode_ordinary(text)


def test_tree_names_the_leftmost_lowest_pair():
    """The root against a scan over all live pairs, after every merge."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 256 + 1, b"abc": 258, b"aa": 259, b"aaaa": 260}
    tree = byte_bpe.PairTree(b"aaabcaabbcabcaaaa", ranks, 4)
    parts = [bytes([b]) for b in tree.piece]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in ranks]
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        if not pairs:
            assert tree.tree[1] == byte_bpe._NONE
            break
        rank, i = min(pairs)
        assert tree.tree[1] == rank * tree.width + starts[i]
        # One merge only: stop the tree's loop by hand.
        at, gone = starts[i], starts[i + 1]
        tree.end[at] = tree.end[gone]
        if tree.end[at] < len(tree.piece):
            tree.before[tree.end[at]] = at
        tree.update(gone, byte_bpe._NONE)
        tree.update(at, tree.pair_key(at))
        if tree.before[at] >= 0:
            tree.update(tree.before[at], tree.pair_key(tree.before[at]))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_query_against_the_library(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op12_byte_bpe(spark, sf_dir).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
