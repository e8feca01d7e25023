"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import bpe, cotraining, mixing, setjoin, substrings
from folioscope.llm.common import settings, table
from folioscope.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go."""
    return cotraining.classify(docs, table(spark, sf_dir, "labels")).where("accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near copies stays."""
    settings(spark)
    return setjoin.one_of_each(docs.select(*COLUMNS), words=5, percent=80)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: a span of 50 words or more stays in the document with the smallest id only."""
    settings(spark)
    return substrings.without_repeats(docs.select(*COLUMNS), window=50)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: a row for each time a document is taken; texts are cut only at a block arc's ends."""
    settings(spark)
    return mixing.mix_documents(docs.select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: ids of every row, and the digests of ids and decoded bytes."""
    settings(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.round_trip(docs, path, public_tokenizers.PATTERN), "ids")


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("repeated_spans", repeated_spans), ("mixture", mixture), ("token_ids", token_ids),
]

#: SQL can't express a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
