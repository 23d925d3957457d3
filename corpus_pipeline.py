"""A corpus pipeline: each stage works on all that the one before kept.

``run`` writes every stage's documents to the shared folder and reads them
back, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speclake.llm import decontaminate, line_dedup, pieces, quality, similar
from speclake.llm.queries import table, tokenizer
from speclake.llm.shared import prepared, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and documents that lose too much or fail the base rules."""
    return quality.cleaned(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks go from the later document; so do documents left without a word."""
    return line_dedup.deduped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return similar.first_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), what="documents")


def token_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and hashes of the ids and of the decoded text."""
    return pieces.encode(docs, tokenizer("piece_bpe_32k.model"), digests=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", token_pieces),
]

# Patience diff and piece merges are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
