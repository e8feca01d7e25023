"""The queries of the operators with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm import arrow_ids, bpe, cotraining, counterfactual, divergence, flatgraph, lsh, mixing, oracle, ring, setjoin, spelling, substrings, wrappers
from folioscope.llm.common import table


def op1_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.apportion(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_text", "p_meta", "score", "accepted")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join_sets(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_arrow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = arrow_ids.write_files(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return arrow_ids.read_documents(manifest)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.round_trip(docs, path, public_tokenizers.PATTERN))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counterfactual.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_flat_graph, op2_mixing, op3_multiprobe, op4_wrappers, op5_ring_shards, op6_quality, op7_ngram_jaccard,
    op8_substrings, op9_arrow_ids, op10_byte_bpe, op11_toxicity, op12_divergence, op13_spelling,
)
QUERIES = {query.__name__: query for query in OPERATORS}
ORACLE_SQL: dict[str, str] = {
    "op1_flat_graph": oracle.NEAR_VECTORS, "op7_ngram_jaccard": oracle.JACCARD, "op8_substrings": oracle.REPEATS,
    "op12_divergence": oracle.DIVERGENCE, "op13_spelling": oracle.SPELLING,
}
