"""N-best segmentation against all segmentations; token counts against the library."""

import random
from collections import Counter

import cases
import pytest
from pyspark.sql import functions as F
from slotwise.llm import piece_nbest as pn
from slotwise.llm import token_counts as tc
from slotwise.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pn.read_model(PATH)


def every_path(lattice, unit):
    out = []

    def go(at, score, ids):
        if at == len(unit):
            out.append((score, ids))
            return
        if unit[at] not in lattice.pieces:
            raw = unit[at].encode()
            go(at + 1, score + lattice.byte_score * len(raw), ids + [lattice.bytes[b] for b in raw])
        for end in range(at + 1, len(unit) + 1):
            found = lattice.pieces.get(unit[at:end])
            if found:
                go(end, score + found[1], ids + [found[0]])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_units_equal_all_paths(model):
    lattice, rng = pn.Lattice(model, 5), random.Random(2)
    units = ["▁", "▁▁▁▁", "▁the", "▁日本xé\n\x00", "▁aaaaaaaa"] + ["▁" + "".join(rng.choice("etaoinshé") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    for unit, found in zip(sorted(units), lattice.units(sorted(units), True), strict=True):
        want = every_path(lattice, unit)
        assert [s for s, _ in found] == pytest.approx([s for s, _ in want[:5]])
        assert len({tuple(i) for _, i in found}) == len(found)
        assert all((pytest.approx(s), ids) in want for s, ids in found)
        assert found[0] == lattice.unit(unit)[0]


def test_texts_combine_units(model):
    encoder = pn.Encoder(model, 4)
    for text in ["", "a", "the cat sat", "x  y\nz", " ".join(cases.sentences(3, 1, 12))]:
        ids, ends, scores = encoder.encode([text])
        best = encoder.segmentations(text)
        assert scores[0] == pytest.approx([s for s, _ in best])
        assert ids.tolist() == best[0][1] and ends.tolist() == [0, len(ids)]


def test_encode_and_decode(spark):
    rows = cases.edge_rows()
    df = cases.table(spark, rows)
    encoded = pn.encode(df, PATH, nbest=3)
    found = encoded.collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in found) == Counter((i, len((t or "").encode())) for i, t in rows)
    assert all(list(r["scores"]) == sorted(r["scores"], reverse=True) for r in found)
    marked = [i for i, t in rows if "▁" in (t or "")]
    assert marked and all(r["round_trip"] == (r["doc_id"] not in marked) for r in found)
    assert all((r["scores"] == [0.0]) == (r["n_bytes"] == 0) for r in found)
    texts = Counter((r["doc_id"], r["text"]) for r in pn.decode(encoded, PATH).collect())
    assert texts == Counter((i, (t or "").replace("▁", " ")) for i, t in rows)
    assert pn.decode(encoded.limit(1).withColumn("ids", F.lit(None).cast("array<int>")), PATH).first()["text"] == ""
    assert pn.encode(cases.table(spark, []), PATH).count() == 0


def test_every_rank_has_its_ids(spark, model):
    """Segmentations 2 to N are those of the whole text's lattice, score as told and decode to the text."""
    lattice = pn.Lattice(model, 4)
    score = {i: s for i, s in lattice.pieces.values()} | dict.fromkeys(lattice.bytes, lattice.byte_score)
    rows = [(1, "the cat"), (2, "a  b\nthe"), (3, "q"), (4, "xé 日"), (5, None), (6, ""), (7, "the the the"), (8, "mat " * 30), (9, "no" * 300)]
    found = {r["doc_id"]: r for r in pn.encode(cases.table(spark, rows), PATH, nbest=4).collect()}
    for i, text in rows:
        r = found[i]
        assert r["ids"] == r["segmentations"][0] and len(r["segmentations"]) == len(r["scores"]) == len({tuple(x) for x in r["segmentations"]})
        assert all(lattice.decode(x) == (text or "") for x in r["segmentations"]) and r["round_trip"]
        assert [sum(map(score.__getitem__, x)) for x in r["segmentations"]] == pytest.approx(r["scores"])
        if i in (1, 2, 3, 4, 7):
            want = every_path(lattice, "▁" + text.replace(" ", "▁"))
            assert r["scores"] == pytest.approx([s for s, _ in want[:4]])
            assert all((pytest.approx(s), x) in want for s, x in zip(r["scores"], r["segmentations"], strict=True))


def test_round_trip_is_of_the_text_itself(spark):
    """The model takes ▁ for a space, so such a text does not come back."""
    rows = [(1, "a▁b"), (2, "a b"), (3, "▁"), (4, " "), (5, "  a"), (6, "\x00é\ud7ff\U0010ffff"), (7, None), (8, "")]
    found = {r["doc_id"]: r["round_trip"] for r in pn.encode(cases.table(spark, rows), PATH, nbest=3).collect()}
    assert found == {1: False, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: True}


def test_full_cache_changes_nothing(model, monkeypatch):
    texts = cases.sentences(8, 20, 30)
    want = [pn.Encoder(model, 3).encode([t])[2] for t in texts]
    monkeypatch.setattr(pn, "CACHE", 5)
    encoder = pn.Encoder(model, 3)
    assert [encoder.encode([t])[2] for t in texts] == want


def test_token_counts_equal_the_library(spark, library):
    rows = cases.edge_rows() + [(500, "<s>x</s> <unk> <0x0A>"), (501, " " * 37 + "a" + " " * 5), (502, "no" * 40000), (503, "▁▁ a ▁")]
    found = tc.count_tokens(cases.table(spark, rows), PATH, limit=100).collect()
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in rows)
    assert Counter(map(tuple, found)) == want
    assert tc.count_tokens(cases.table(spark, []), PATH).count() == 0


def test_transducer_on_random_texts_and_chunks(library, model):
    counter, rng = tc.Counter(model), random.Random(5)
    pieces = sorted(counter.machine.score)
    for turn in range(1500):
        if turn % 3 == 0:
            text = "".join(rng.choice(" ab\nthe\té日▁") for _ in range(rng.randrange(40)))
        elif turn % 3 == 1:
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))).replace("▁", " ")
        else:
            text = " " * rng.randrange(40) + "".join(rng.choice("etaoinshrdlu ") for _ in range(rng.randrange(60)))
        want = len(library.encode(text))
        assert counter.count(text) == want
        for size in (1, 7, 16):
            ends = counter.chunk_ends(text, size)
            assert (ends[-1] if ends else 0) == want


def test_composition_is_associative(model):
    counter, rng = tc.Counter(model), random.Random(7)
    for _ in range(200):
        a, b, c = (counter.chunk_map("".join(rng.choice("▁▁aethx") for _ in range(rng.randrange(1, 9)))) for _ in range(3))
        left, right = counter.compose(counter.compose(a, b), c), counter.compose(a, counter.compose(b, c))
        assert [left[0], left[2]] == [right[0], right[2]] and left[1] == right[1]


def test_forgetting_changes_nothing(library, model, monkeypatch):
    monkeypatch.setattr(tc, "KEPT", 10)
    counter = tc.Counter(model)
    for text in cases.sentences(17, 30, 20):
        counter.trim()
        assert counter.count(text) == len(library.encode(text))


def test_unspelt_search_gives_the_scores_of_the_spelt_one(model):
    """The quick search of the encoder against the heap, also where losses tie and paths run out."""
    lattice = pn.Lattice(model, 4)
    rng = random.Random(5)
    units = sorted({pn.SPACE * rng.randrange(1, 4) + "".join(rng.choice("aeinrst1日é") for _ in range(rng.randrange(0, 30))) for _ in range(400)})
    quick, spelt = list(lattice.units(units)), list(lattice.units(units, True))
    assert [[s for s, _ in own] for own in quick] == [[s for s, _ in own] for own in spelt]
    assert [own[0][1] for own in quick] == [own[0][1] for own in spelt]
