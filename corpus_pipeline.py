"""A corpus pipeline: five stages over the table of documents, each written and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, quality_classifier, quality_rules, simhash_dedup, source_mix
from tidemark.llm.common import fold
from tidemark.runtime import materialise, release, scope, trimming


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _lean(stage: Stage) -> Stage:
    """``stage``, between whose queries the driver gives back native memory: the five run over a hundred in one session."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with trimming(spark):
            return stage(spark, docs, sf_dir)

    return run


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_lean
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from every third fold but one, as its query does."""
    model = quality_classifier.train(docs, _labels(spark, sf_dir), fold("doc_id", 3) != 1)
    return quality_classifier.keep_good(docs, model)


@_lean
def passes_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_passing(docs, quality_rules.train(docs, _labels(spark, sf_dir)))


@_lean
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return simhash_dedup.keep_one(docs)


@_lean
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for the first and for the second time a document is taken, always whole."""
    return source_mix.take(docs)


@_lean
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, source and language with each text's token ids, their number and digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(docs, [docs["doc_id"], docs["lang"], docs["source"]], path, public_tokenizers.PATTERN, ids="ids")


STAGES = [
    ("quality classifier", good_quality),
    ("quality rules", passes_rules),
    ("simhash near-dedup", one_of_each),
    ("source mix", mixed),
    ("byte-level bpe", encoded),
]

#: SQL can't express the trained stages; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for _, stage in STAGES[:-1]:
        with scope(kept := []):
            docs = materialise(stage(spark, docs, sf_dir), "stage")
            kept.append(docs)
        release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
