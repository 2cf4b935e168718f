"""A training corpus in five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of documents from all but the last,
the token ids of each document from the last. Other columns than those named are carried along and never read, whatever
their names. Between stages the rows stand in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlight.llm import bpe, decontaminate, langid, near_copies, pii
from ringlight.llm.common import read_table
from ringlight.session import checkpointed, ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, learned from the rows with ``lang``: null and empty texts, texts without letters and
    undecided ones go; without a row to learn from all do. Repeated rows are judged alike."""
    ship_package(spark)
    return langid.accepted(docs, langid.fit(langid.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies: five-word shingles, a similarity of 0.8 or more. Texts without
    a word (null, empty) are one group; rows without an id stay; rows that share an id are judged by their own texts."""
    ship_package(spark)
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts stay, repeated rows are judged alike, and an empty
    benchmark takes nothing."""
    return decontaminate.clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``<kind>`` in place of personal data and n_chars of the new text. A null text stays null with
    n_chars 0; every row stays, repeated ones too."""
    ship_package(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of all documents; a null text counts as empty, with no tokens."""
    ship_package(spark)
    return bpe.encoded_documents(docs, bpe.default_vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]

#: The stages' models can't be expressed in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
