"""A training corpus from documents: five stages, each one of the operators of quarry.llm.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. run() writes each stage's result to the
shared folder (spark.checkpoint.dir) as Parquet and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, quality, sentencepiece, simhash, surrogates
from quarry.llm.shared import cut_table, cut_tables, remove_tables, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy a test item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the text; n_chars follows."""
    return surrogates.replace_entities(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, without its text."""
    return sentencepiece.encode_texts(docs, keep_ids=True).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("tokens", tokens),
]
#: No SQL can align, decode or tokenise; the tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. What a stage cut goes once its result is written; the last result reads the last table."""
    docs, old = table(spark, sf_dir, "documents"), cut_tables()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            used = [p for p in cut_tables() if p not in old]
            docs = cut_table(docs)
            remove_tables(spark, used)
    return docs
