"""The corpus pipeline: documents pass toxicity, exact and near duplicates and mixing, then are encoded.

Every stage works on all rows that its predecessor wrote; all but the last return the columns of documents, further ones of
any name included. Null and empty texts are equal texts: one row of them stays, of which the mix takes no words, so it goes
there. Rows count by id and text, so a null or repeated id loses no text; of copies the longest original, then the smallest
id stays, of near copies the smallest id. Texts of any length pass whole. An empty table passes every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkshapes.llm.common import read_table, stored
from sparkshapes.llm.exact_dedup import drop_copies
from sparkshapes.llm.mixing import mixed
from sparkshapes.llm.near_dedup import keep_one
from sparkshapes.llm.sentencepiece_codec import default_codec, round_trip
from sparkshapes.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half; the labels table trains the model."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of five-word shingles."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token count and digests of its ids and of what they decode to."""
    return round_trip(docs, default_codec()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]
#: Trained scores, seeded choices and token ids are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
