"""The corpus pipeline: five stages over documents, each one operator of ``rasterloom.llm``.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it
kept, and gives a DataFrame that is written as Parquet and read again for the
next. All but the last give the columns of ``documents``, whatever else these
are named; an empty table gives no row at any stage. Null columns: a document
whose text is null, empty or without a letter has no language and goes in the
first stage; a null doc_id is an id like others and a null source a source of
its own. Texts of any length go through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import common, decontam, langid, minhash, mixing, tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected: not null, not without letters, not of a language without a model. Repeated rows are judged alike."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id; rows of equal text are one group. Ties and nulls: see ``minhash``."""
    return minhash.keep_firsts(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without the spans that they share with the benchmark; items that are null or empty hit nothing, repeated ones count once."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"), keep=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order; one without words is taken at most as its size of 0 says. Ties of position go by content."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the token files that are written, in the training order in which the mix is stored; a document that was taken twice is there twice."""
    return tokens.token_digest(docs, stored=tokens.is_stored(docs))


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_output", token_output),
]

#: The tokenizer and the draws of the mix are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
