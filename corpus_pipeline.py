"""From raw documents to token identifiers, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's documents; all but the last keep the columns of their
input, whatever they are called. As its input has been written by then, a stage deletes
what the one before it has left in the shared folder.

Every stage passes an empty table on, takes doc_ids of any type and treats rows equal in
doc_id and text alike. Null and empty texts fail the base quality rules, so none comes
beyond the first stage; where a later stage is called alone, they stay as they are and
are encoded as no tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lorequarry.llm import bpe, common, decontaminate, jaccard_join, line_dedup, quality_rules
from lorequarry.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[common.Scratch] = []


def stage(f: Stage) -> Stage:
    """Deletes what the stage before has left, and remembers what this one leaves."""

    @wraps(f)
    def run_stage(spark, docs, sf_dir):
        for scratch in _left:
            scratch.release()
        _left.clear()
        with common.opened() as scratches:
            out = f(spark, docs, sf_dir)
        _left.extend(scratches)
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go; without labels only the former do."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.filter_documents(docs, rules)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines stays; a document of which nothing is left goes."""
    return line_dedup.clean_documents(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least doc_id: five-word shingles, Jaccard 0.8."""
    return jaccard_join.keep_one(docs, shingle=5, percent=80)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of what is left, counted and digested, with the digest of the decoded text."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.json"), "doc_id")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encoding),
]
#: SQL can't express the learned rules, MinHash components or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.documents(spark, sf_dir), None
    for name, f in STAGES:
        scratch = common.Scratch(spark)
        docs = scratch.write(f(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.release()
        before = scratch
    return docs
