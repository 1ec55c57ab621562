"""The registered queries over the whole small tables, and the pipeline."""

import hashlib
import re
import zlib

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from oracle_compare import compare, duck_connection
from slotwise.llm import queries
from slotwise.llm.common import stage_table


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, sf_dir, name):
    result = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir, duck_connection(sf_dir))
    assert result["columns_match"] and result["values_match"] and result["spark_rows"] == result["oracle_rows"], result


def test_one_query_of_each_operator():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_op4_and_op10_agree_on_bytes(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = {r["doc_id"]: r for r in queries.op4_sentencepiece_nbest(spark, sf_dir).collect()}
    tokens = {r["doc_id"]: r for r in queries.op10_token_counts(spark, sf_dir).collect()}
    assert set(docs) == set(pieces) == set(tokens)
    assert all(pieces[i]["n_bytes"] == tokens[i]["n_bytes"] == len(t.encode()) and pieces[i]["round_trip"] for i, t in docs.items())


def test_op4_hashes_every_segmentation(spark, sf_dir):
    found = queries.op4_sentencepiece_nbest(spark, sf_dir).collect()
    assert all(r["nbest_hashes"][0] == r["ids_hash"] and len(set(r["nbest_hashes"])) == len(r["scores"]) for r in found)


def test_op5_scores_every_document(spark, sf_dir):
    found = queries.op5_toxicity(spark, sf_dir).collect()
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)


@pytest.mark.parametrize(("name", "table"), [("op6_quality_rules", "documents"), ("op8_license_scan", "documents"), ("op9_url_filter", "pages")])
def test_one_row_per_input_row(spark, sf_dir, name, table):
    assert entry.queries()[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_pipeline_stages(spark, sf_dir):
    """Every stage's result follows from the operators' own rows on its input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage_table(stage(spark, docs, sf_dir), f"test-{name}")
        tables[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    from slotwise.llm import decontaminate, ngram_join, quality_rules, substring_dedup

    before, after = tables["quality_rules"]
    assert ids(after) == ids(quality_rules.score(before).filter("kept"))
    before, after = tables["ngram_jaccard_join"]
    assert ids(after) == ids(ngram_join.ngram_components(before).filter("doc_id = component_id"))
    before, after = tables["substring_dedup"]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    cut = {r["doc_id"]: r for r in substring_dedup.remove_repeats(before).collect()}
    for r in after.collect():
        assert r["text"].encode().split() == cut[r["doc_id"]]["text"].encode().split()
        assert cut[r["doc_id"]]["n_removed"] or r["text"] == old[r["doc_id"]]
    assert ids(before) == ids(after)
    before, after = tables["benchmark_decontamination"]
    hits = decontaminate.find_hits(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert ids(after) == ids(hits.filter("not contaminated"))
    before, after = tables["sentencepiece_nbest"]
    assert ids(after) == ids(before) and after.filter("not round_trip").count() == 0


def test_digests_are_lower_hex(spark, sf_dir):
    found = queries.op7_benchmark_decontamination(spark, sf_dir).filter("n_items = 0").first()
    assert found["items_sha256"] == hashlib.sha256(b"").hexdigest()
