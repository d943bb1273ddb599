"""Cleaning a corpus for training, in five stages over one table of documents.

Each stage takes (spark, docs, sf_dir), with docs as the stage before wrote them. All but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from viatrix.llm.decontaminate import leaks
from viatrix.llm.line_dedup import dedup_lines
from viatrix.llm.ngram_join import near_groups
from viatrix.llm.packing import pack
from viatrix.llm.store import Cuts
from viatrix.llm.toxicity import drop_toxic
from viatrix.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from this stage's documents and the labels."""
    return drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of two or more lines go, and documents of which nothing is left."""
    cut = dedup_lines(docs.select(*COLUMNS), 2)
    kept = cut.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id."""
    extra = near_groups(docs, 5, 75, 100).where("doc_id <> component_id").select("doc_id")
    return docs.select(*COLUMNS).join(extra, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaked = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(leaked, "doc_id", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: the toxicity stage is a trained model, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = Cuts(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = cuts.cut(stage(spark, docs, sf_dir))
        cuts.drop(docs)  # what a stage has read; the table of documents is none of these
        docs = done
    return docs
