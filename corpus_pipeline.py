"""The training-data pipeline over ``documents``: quality, exact and near duplicates, benchmark passages, pieces.

Every stage takes any columns beside doc_id and text, under any names, and passes them on; an empty table gives an
empty table, a text of any length is worked on whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import common, op02_quality, op03_minhash, op05_pieces, op06_exact, op10_contamination


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    A null or empty text is scored like any text without words, equal texts alike, so repeated rows stay or go
    together; a row with a null id is scored too. A score that ties with the threshold is kept. Without usable labels
    nothing goes.
    """
    return op02_quality.keep_good(docs, common.read(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts.

    A null text counts as empty, and one of the empty ones stays. Of equal texts the longest in code points stays, of
    ties the smallest id (a null id comes last), of rows that repeat an id and its text one row.
    """
    return op06_exact.keep_one(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the smallest id.

    Null and empty texts are near nothing and stay, as does a row with a null id. Rows that repeat an id stay if one
    of them represents its group.
    """
    return op03_minhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold at least 0.8 of a benchmark item's five-word shingles, the bound included.

    Null and empty texts and items hold nothing; repeated rows go or stay together, whatever their ids.
    """
    return op10_contamination.drop_contaminated(docs, common.read(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of what is left, one row for each row.

    A null text counts as empty and has no pieces; the draws follow the id (null is one more id), so rows that repeat
    an id and its text get the same pieces.
    """
    return op05_pieces.sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", good),
    ("exact_dedup", distinct),
    ("minhash_near_dedup", unlike),
    ("benchmark_decontamination", clean),
    ("sentencepiece_sampling", pieces),
]

#: A classifier, a signature search and sampling are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; a stage's table goes when the next one is written."""
    docs, before = common.read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = common.save(stage(spark, docs, sf_dir), name)
        common.drop(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
