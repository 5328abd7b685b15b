"""The corpus pipeline: quality filter, line dedup, near-dedup, decontamination, packing.

Every stage takes the documents its predecessor kept, as (spark, docs, sf_dir), and returns a
frame that is written as Parquet and read again for the next one. All but the last return the
columns of ``documents``; n_chars follows the text. Rows are kept whole: a document goes only
where a stage says so. Texts are taken whole at any length, empty tables give empty results, and
further columns are carried along unless they have the name of an operator's output, which its
stage would replace.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creatorlens.llm import common, decontaminate, line_runs, packing, quality, simhash_trie
from creatorlens.llm.catalog import tokenizer_path

SHINGLE_WORDS = 3
NEAR_BITS = 2
LINE_DOCS = 10


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns as the op5 query does. Null and empty texts
    are judged by the shares of the classes; repeated rows share their fate."""
    learn = common.table(spark, sf_dir, "labels").select("doc_id", "quality").where(quality.fold("doc_id", 3) != 1)
    model = quality.train(docs, learn)
    return quality.scored(docs, model).where("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ``LINE_DOCS`` documents go; the documents stay, even if nothing is left. A null text
    becomes one empty line; each repeated row counts as a document."""
    return line_runs.dedup_lines(docs, LINE_DOCS).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id, or any of those without an
    id if no row has one. Groups are those of the SimHash operator, as the op6 query calls it;
    documents that line dedup left without a word are one group."""
    found = simhash_trie.near_duplicates(docs, SHINGLE_WORDS, NEAR_BITS)
    return found.where("first").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go. Texts without words stay; repeated rows share their
    fate."""
    found = decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences: the pieces of every document left, texts without words as the end id
    alone. Of the columns doc_id and text are read."""
    return packing.pack(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _scoped(stage: Stage) -> Stage:
    """A stage starts when the one before has been written: its stored tables can go."""

    @wraps(stage)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with common.scope(spark, "pipeline"):
            return stage(spark, docs, sf_dir)

    return staged


STAGES: list[tuple[str, Stage]] = [
    ("quality_filter", _scoped(quality_filter)),
    ("line_dedup", _scoped(line_dedup)),
    ("near_dedup", _scoped(near_dedup)),
    ("decontamination", _scoped(decontamination)),
    ("packing", _scoped(packed)),
]

#: The classifier's training is no SQL; the pipeline is tested stage by stage instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written below spark.checkpoint.dir."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
