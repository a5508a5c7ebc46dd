"""The text pipeline: quality rules, near duplicates, personal data, source mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
back as the next stage's docs. All but the last return the columns of `documents`.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import bpe, mixing, pii, quality, simhash
from threatloom.llm.frames import kept_in_table, quoted
from threatloom.llm.queries import REPEATS, VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the learnt score rejects go. Null and empty texts fail a base rule; equal rows go or
    stay together; columns keep their names and values; an empty table stays empty."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return simhash.one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows the new text. A null text stays null, as does its
    n_chars; rows are neither dropped nor joined; further columns stay as they are."""
    masked = docs.withColumn("text", pii.mask(F.col("text"), pii.fit(docs)))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated towards even weights, every document is kept once at least. A null source is a source."""
    return mixing.mix(docs, repeats=REPEATS).select(*[quoted(name) for name in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with its id and source; `exact` says that decoding gives the text back. A null text has no ids."""
    coded = bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), ["doc_id", "lang", "source", "text"])
    exact = F.col("coded.decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", "coded.ids", "coded.n_tokens", exact.alias("exact"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mixture", source_mixture),
    ("tokens", tokens),
]

#: Hashes, trained models and the tokenizer are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept_in_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
