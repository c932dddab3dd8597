"""From raw documents to packed sequences: a fixed order of stages over the ``documents`` table.

Each stage works on all rows its predecessor kept. All but the last return the
columns of ``documents``; each result is written as Parquet in the shared folder
and read again as the next stage's input. Other columns pass through, whatever
their names; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import neardup, packing, quality, substrings, toxicity
from tallyforge.llm.common import settle, table
from tallyforge.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules or the log-likelihood ratio reject go.

    Null and empty texts have no words and go; texts of any length are read whole. A score equal to the threshold stays.
    Rows that repeat an id are judged one by one. Without labels of both kinds only the counting rules reject.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_grades(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic reaches the model's cut go.

    A null or empty text has the base rate and stays. Equal texts share their fate; without labels of both kinds all stay.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the least id; rows without an id come last.

    Null and empty texts are one class. Of rows that repeat both id and text one stays.
    """
    return neardup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out; a document may become empty, but stays.

    A null text stays null; a document without an id keeps its text. Rows that repeat an id don't cut each other.
    """
    return substrings.cut_texts(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their places in sequences of at most 1024 tokens.

    A null or empty text is one piece that holds the end id alone; long texts are cut, nothing is dropped.
    """
    return packing.pack(packing.pieces_of(docs, vocabulary("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_grades),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed_sequences),
]

#: Models, sampling and packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
