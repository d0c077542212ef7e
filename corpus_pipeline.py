"""A training corpus from raw documents: quality, language, near duplicates, benchmark leaks, token ids.

``STAGES`` are applied in order; each takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
decides for itself. All but the last return the columns of documents; the last returns token ids. Texts are shuffled
in the near-duplicate stage only, once.

Defined results: null and empty texts are rejected by the language stage at the latest, as they have no letter. Rows
of equal doc_id are judged each. Equal texts are one group of near duplicates. An empty input gives an empty result.
Columns besides those of documents stay as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm import decontaminate, language, quality, sentencepieces, simhash
from kmerloom.llm.base import table, written

#: The file of a public tokenizer that the corpus is encoded with.
TOKENIZER = "piece_bpe_32k.model"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the classifier predicts to be of quality. Null and empty texts are scored like any other, equal texts
    alike; without labels all stay."""
    return quality.good_rows(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents in a language learned from them. Null texts and texts without a letter go; rows of equal id are judged each."""
    return language.known_rows(docs, language.fit(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near duplicates (shingles of five words, similarity 0.8 or more) the document with the smallest id.

    Null and empty texts are one group, as are equal texts; of rows of equal id the one with the smallest hash of text stays.
    """
    return simhash.first_of_each_group(docs)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold no benchmark item. Null and empty texts hold none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: (doc_id, n_tokens, ids) of each document; null and empty texts have no ids."""
    return sentencepieces.encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("benchmark", free_of_benchmark),
    ("token_ids", token_ids),
]

#: Neither learned scores nor XXH64 nor merges can be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
