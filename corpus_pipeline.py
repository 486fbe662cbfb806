"""The corpus pipeline: documents pass five stages, each by one of the operators in fairline.llm.

1. toxicity: documents that score 0.5 or more go.
2. language: documents without a language, or with less than 0.4 of their words in one, go.
3. near_duplicates: one document stays of each group of texts whose word 5-grams have a similarity of 0.8 or more.
4. decontamination: documents in which a window of the benchmark occurs go.
5. tokens: what is left is encoded; a row per document with its number of ids, a digest of the ids and one of the text decoded from them.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns that they are given.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fairline.llm import op3_decontaminate, op6_bpe, op7_language, op8_neardup, op10_toxicity
from fairline.llm.common import settle, table
from fairline.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_language.drop_unclear(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_neardup.drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_bpe.digests(docs, tokenizer_path(), cache=100_000)           # the workers have served four stages before


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: Learned scores and byte-pair merges are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
