"""The corpus pipeline: documents pass the stages in order; each stage's rows are written and read again.

All stages but the last return the columns of documents. Toxicity and language ID drop the documents they reject,
the n-gram Jaccard join keeps one document of each group, decontamination drops contaminated documents, and byte-level
BPE encodes what is left.

Null and empty texts, and those without a letter, are rejected by language ID (they score 0 in toxicity, which keeps them). Of rows that
repeat an id, all with the same text or linked texts are one group, of which one stays; others are documents of their own. Of linked
documents the smallest doc_id stays. Texts are worked on whole in each stage. Columns beyond those of documents pass through all stages
but the last. Without labels nothing is learned and toxicity keeps all; without learned languages all are rejected. An empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import queries
from corpusmill.llm.bpe import bpe
from corpusmill.llm.common import Written, table
from corpusmill.llm.decontamination import decontaminate
from corpusmill.llm.language_id import keep_identified
from corpusmill.llm.ngram_jaccard import one_of_each
from corpusmill.llm.toxicity import keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. Learns from those of the stage's documents that are labelled."""
    return keep_clean(docs, table(spark, sf_dir, "labels"), queries.toxicity_rows())


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Documents without a letter, or far from each learned language, go."""
    return keep_identified(docs, queries.language_rows())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. One document of each group stays: the least doc_id."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip."""
    return bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("language_id", drop_unknown_language), ("ngram_jaccard", drop_near_copies), ("decontamination", drop_contaminated), ("bpe", encode)]

#: Learned models are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder. Each stage's input goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        written = Written(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = written.df, written
    return docs
