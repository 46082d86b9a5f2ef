"""A training-data pipeline over documents: quality rules, quality classifier, n-gram Jaccard join, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. The first three return rows
of docs with all their columns; the last returns the packed pieces. Between stages the rows are written as Parquet to
the shared folder and read again, so a lost executor repeats one stage at most; a table is deleted when the next one is
written, and so is what a stage stores on its way.

Verdicts belong to rows: of two rows with one id (or none) one can go and the other stay. Null and empty texts fail the
quality rules. A null language or source is a group of its own. Of rows that repeat an id the third stage keeps
one; rows without an id are no copies of each other there and all stay. An empty table gives no rows at every stage. Other columns
are handed on whatever their names; `lang` and `source` have to be there.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import common, jaccard_join, packing, quality_classifier, quality_rules

#: SQL can't express the robust estimates, the fitted model or the packing; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no robust outliers of their language and source."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted to the labels, holds to be good."""
    ratings = quality_classifier.graded(common.table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, ratings))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, common.settled(spark, partial(stage, spark, docs, sf_dir))
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
