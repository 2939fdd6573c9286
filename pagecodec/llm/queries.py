"""The registered queries of this subpackage: each runs its operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ctph, langid, lm_scoring, mixing, quality_lines, sentencepiece_backend, simhash, token_counts, toxicity, warc


def tokenizer_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit_sample(docs, load(spark, sf_dir, "labels")))
    return out.drop("c1").withColumnRenamed("c0", "doc_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.normalised_pages(load(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op4_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.quality_lines(load(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_backend.encode(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = langid.identify(docs, langid.fit_sample(docs))
    return out.selectExpr("c0 as doc_id", "c2 as declared", "lang_found", "posterior", "accepted")


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with all four kinds of evidence: markup, address suffix, host and text."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    cols = langid.Columns(text="html", declared=None, host=None, url="url")
    out = langid.identify(pages, langid.fit_sample(load(spark, sf_dir, "documents")), cols)
    return out.selectExpr("c0 as page_id", "c1 as url", "lang_found", "posterior", "accepted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edited_neighbours(load(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = load(spark, sf_dir, "labels").where("quality = 1").selectExpr("doc_id as id")
    return lm_scoring.score(load(spark, sf_dir, "documents"), good)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_quality_lines": op4_quality_lines,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_langid": op6_langid,
    "op7_token_counts": op7_token_counts,
    "op8_ctph": op8_ctph,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_simhash": op10_simhash,
    "langid_pages": langid_pages,
}

ORACLES: dict[str, str] = {"op2_warc": warc.ORACLE, "op3_mixing": mixing.ORACLE}
