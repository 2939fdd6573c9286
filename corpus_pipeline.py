"""A corpus pipeline of five stages: language ID, toxicity, SimHash near-dedup, mixing, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagecodec.llm import common, langid, mixing, sentencepiece_backend, similar, toxicity
from pagecodec.llm.queries import load, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found."""
    return langid.accepted_only(docs, langid.fit_sample(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return toxicity.clean_only(docs, toxicity.fit_sample(docs, load(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a similarity of 0.8 or more of five-word shingles."""
    return similar.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix."""
    return sentencepiece_backend.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("language", language), ("toxicity", clean), ("simhash", dedup), ("mixing", mix), ("sentencepiece", tokenize)]

#: Classifiers and components can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
