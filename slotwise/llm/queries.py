"""The ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import (
    byte_bpe, decontaminate, license_scan, ngram_join, piece_nbest, quality_rules, source_divergence,
    substring_dedup, token_counts, toxicity, url_filter, va_kmeans, warc,
)
from slotwise.llm.common import scratch_dir
from slotwise.llm.oracle import ORACLE_SQL as ORACLE_SQL
from slotwise.llm.url_labels import labelled_urls


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    """Pattern that splits text before the merges of the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of every document once those in repeated 35-word windows are removed."""
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    found = ngram_join.ngram_components(_table(spark, sf_dir, "documents"), size=5, percent=80)
    return found.select("doc_id", "n_shingles", "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the WARC files written for it."""
    base = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
    warc.write_warc(_table(spark, sf_dir, "pages"), base)
    return warc.read_warc(spark, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every document, their scores and whether decoding each gives the text back."""
    found = piece_nbest.encode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), nbest=3)
    hashes = F.slice(F.array(*(F.xxhash64(F.get("segmentations", F.lit(i))) for i in range(3))), F.lit(1), F.size("segmentations"))
    return found.select("doc_id", "n_bytes", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "scores", "round_trip", hashes.alias("nbest_hashes"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of the held-out third are not learned."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    machine = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.score(docs, machine, threshold=0.7)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the suffix-array repetition verdict of every document."""
    return quality_rules.score(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word overlaps of every document with the benchmark items."""
    found = decontaminate.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    joined = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory above it.

    The documents have no paths, so their ids lay them out as a tree: hundreds of
    files below thousands below the source.  The first file of a directory is its
    licence file.
    """
    docs = _table(spark, sf_dir, "documents")
    far, near = F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100)
    name = F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.lit(".txt"))
    top, low = F.col("doc_id") % 1000 == 0, F.col("doc_id") % 100 == 0
    path = F.when(top, F.concat_ws("/", F.lit("corpus"), far, F.lit("LICENSE"))).otherwise(F.concat_ws("/", F.lit("corpus"), far, near, F.when(low, F.lit("LICENSE")).otherwise(name)))
    return license_scan.scan(docs.select("doc_id", path.alias("path"), "text"), keep=["doc_id"])


#: The rules of the url query (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the rule's, else that of a model learned from the small labelled table."""
    labelled = spark.createDataFrame(labelled_urls(), "url string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES, labelled)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32k piece model."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding after three rounds with 16 centroids."""
    found = va_kmeans.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", va_kmeans.centroid_hash(F.col("centroid")).alias("centroid_sha256"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes that they decode to, as digests."""
    path, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern()
    coded = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each source's terms from every other source and from the whole language."""
    return source_divergence.audit(_table(spark, sf_dir, "documents"), min_docs=3, top=200, scale=1_000_000_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_warc": op3_warc,
    "op4_sentencepiece_nbest": op4_sentencepiece_nbest,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_url_filter": op9_url_filter,
    "op10_token_counts": op10_token_counts,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_source_divergence": op13_source_divergence,
}
