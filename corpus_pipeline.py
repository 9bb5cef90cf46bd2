"""Corpus pipeline: toxic documents, repeated lines, near copies and benchmark leaks go; the rest is tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder as Parquet
and reads again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import cut, drop_cut, fold_of, table
from quayside.llm.decontaminate import decontaminate
from quayside.llm.jaccard_join import drop_near_copies
from quayside.llm.line_dedup import line_dedup
from quayside.llm.sentencepiece_fst import encode_pieces
from quayside.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the compression-distance classifier predicts as not toxic."""
    labels = table(spark, sf_dir, "labels").filter(fold_of(F.col("doc_id"), 5) != 0)
    return score_toxicity(docs, fit_toxicity(docs, labels)).filter("predicted = 0").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document of which nothing stays goes, if it had text."""
    found = line_dedup(docs).filter("n_dropped = 0 or text <> ''")
    changed = F.col("n_dropped") > 0
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return drop_near_copies(docs).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left; ``piece_ids`` are the training tokens."""
    return encode_pieces(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("sentencepiece", pieces),
]

#: Toxicity and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        after = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            drop_cut(docs)
        docs = after
    return docs
