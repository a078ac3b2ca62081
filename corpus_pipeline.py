"""A corpus pipeline over documents: language ID, near-dedup, redaction, mixing and packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import langid, mixing, neardup, packing, pii
from logloom.llm.common import read, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (`und`: null texts, texts without a letter) go; lang becomes the language found.

    The model is fitted on the stage's own documents, as far as they aren't held out and have a lang. Where none do, there is nothing to tell
    languages by: documents with a letter stay, with the lang they have.
    """
    model = langid.fit_documents(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, model).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 5-word Jaccard similarity of 0.8 or more stays: the one with the smallest id."""
    return neardup.deduplicate(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; n_chars follows the text."""
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, packing.tokenizer_path(), with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: No stage of those above can be put in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
