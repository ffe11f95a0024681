"""A corpus pipeline of five of the training-data operators, each stage working on all that the last one kept.

language_id drops rows whose language is not recognised; near_duplicates keeps one document of each
group linked by a Jaccard likeness of five-word shingles of at least 0.8; repeated_passages takes
strings of ``PASSAGE`` bytes that occur twice out of the texts; mixture draws words from the sources to their
target weights (rows may repeat, one row a source is cut); packing places all token pieces into sequences of 2048.

Defined cases: null, empty and letterless texts go in the first stage; of rows alike in id and text
one stays; of rows of one id with different texts, those that are no near-copies of another stay, each; a
text that loses all its words to repeats goes, as do wordless texts in the mixture; a null source is a
source of its own; an empty table gives an empty result; other columns, whatever their names, are
carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugework.llm import _scale, langid, mixing, nearcopies, packing, suffix_dedup

#: Bytes of a repeated string that goes: shorter than 95 % of the passages of 51 words that documents share
#: (their median is 312 bytes), so that passages of over 50 words are caught, unlike with the 400 of op2_suffix_dedup.
PASSAGE = 256


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cleaned(docs, PASSAGE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packing_stage),
]

#: The first three stages learn, link texts and cover bytes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _scale.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
