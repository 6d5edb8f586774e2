"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame;
``run`` writes each as Parquet in the cluster's shared folder and reads it again as the next one's docs. All
but the last keep the columns of ``documents``.

Nulls, empty texts and repeated rows: the quality classifier scores a null or empty text as one without
words; the quality rules drop it (under 50 words). Of the rows of a near-duplicate group that with the smallest
doc_id stays; rows without doc_id come last in their group. An empty table gives an empty result. Extra columns pass
through, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import decontam, line_rules, near_sets, packing, quality_rank
from tidegrid.llm.common import scratch, staged
from tidegrid.llm.queries import table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pairwise-ranking score is at or over the cut (op3's model, from all labels)."""
    model = quality_rank.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_rank.quality(model) >= quality_rank.CUT)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose words are mostly in content lines (op9)."""
    return docs.filter(line_rules.verdict(line_rules.train(docs))["kept"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id (five-word shingles, Jaccard 0.8 or more)."""
    return near_sets.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item (op10)."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences (op2)."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the trained models and the tokenizer; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself, and the stage before it, is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as clear:
        for name, stage in STAGES:
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            clear()
    return docs
