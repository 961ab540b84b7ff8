"""A corpus pipeline of five stages, from raw documents to encoded training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next stage's docs. An empty table gives
an empty one, columns may have any names and hold nulls, and texts of any
length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm import digest_index, line_crf, ngram_join, piece_codec, source_mix
from lodestrand.llm.common import load, removed, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the CRF finds good for the most part. Null and empty texts are judged as one empty line; rows that repeat are judged alike."""
    return line_crf.good_documents(docs, load(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id; null texts are empty. A row without a doc_id stays only if no row with one has its text."""
    return digest_index.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five-word shingles, the one with the smallest doc_id. Texts without words are near nothing; rows without a doc_id come after all others."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at a temperature at which none is read more than twice and none less than once, so that no document is dropped. A null source is one of its own."""
    return source_mix.mix_rows(docs, max_repeat=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, and whether decoding gives the text back. Null and empty texts have no ids; columns named token_ids and round_trip are replaced."""
    return piece_codec.encoded(docs, out="token_ids", check="round_trip")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: The quality model, components and Viterbi encoding have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
