"""The pipeline's stages on edge rows: null and repeated ids, emptied texts, an empty table, other columns."""

from collections import Counter

import cases
import corpus_pipeline
from slotwise.llm import ngram_join, piece_nbest, quality_rules, substring_dedup

STAGES = dict(corpus_pipeline.STAGES)


def chain(spark, df, sf_dir, names):
    for name in names:
        df = STAGES[name](spark, df, sf_dir)
    return df


def test_stages_keep_columns_and_rows(spark, sf_dir):
    rows = cases.edge_rows()
    df = cases.table(spark, rows)
    for name in list(STAGES)[:-1]:
        out = STAGES[name](spark, df, sf_dir)
        assert out.schema.simpleString() == df.schema.simpleString(), name
        found = Counter(r["doc_id"] for r in out.collect())
        assert all(n <= Counter(i for i, _ in rows)[i] for i, n in found.items()), name
    kept = Counter(map(tuple, STAGES["quality_rules"](spark, df, sf_dir).collect()))
    score = quality_rules.score(df.select("doc_id", "text"))
    assert sum(kept.values()) == score.filter("kept").count()
    cut = STAGES["substring_dedup"](spark, df, sf_dir)
    assert cut.count() == len(rows)


def test_emptied_texts_keep_their_rows(spark, sf_dir):
    text = cases.sentences(61, 1, 40, 5000)[0]
    df = cases.table(spark, [(1, text), (2, text), (3, None), (None, text + " more words")])
    out = STAGES["substring_dedup"](spark, df, sf_dir)
    found = {r["doc_id"]: (r["text"] or "").split() for r in out.collect()}
    assert found == {1: [], 2: [], 3: [], None: ["more", "words"]}
    rest = chain(spark, out, sf_dir, ["benchmark_decontamination", "sentencepiece_nbest"]).collect()
    assert {r["doc_id"]: len(r["ids"]) > 0 for r in rest} == {1: False, 2: False, 3: False, None: True}


def test_rows_of_one_id_with_unlike_texts_stay(spark, sf_dir):
    texts = cases.sentences(62, 3, 60, 5000)
    df = cases.table(spark, [(7, texts[0]), (8, texts[1]), (8, texts[2])])
    assert Counter(r["doc_id"] for r in STAGES["ngram_jaccard_join"](spark, df, sf_dir).collect()) == {7: 1, 8: 2}


def test_empty_table(spark, sf_dir):
    df = cases.table(spark, [])
    assert chain(spark, df, sf_dir, STAGES).count() == 0


def test_stages_call_their_operators():
    called = [ngram_join.keep_one, quality_rules.keep, substring_dedup.remove_repeats, piece_nbest.encode]
    assert all(callable(f) for f in called) and list(STAGES) == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "sentencepiece_nbest"]
