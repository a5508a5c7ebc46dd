"""One registered query per operator, each over its whole table with production settings."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import bpe, hnsw, merkle, mixing, pii, pitman_yor, quality, repeats, simhash, sql, token_counts, toxicity, url_filter, whitening

VOCABULARY = "byte_bpe_50k.json"
URL_RULES: list[url_filter.Rule] = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: No source is read more than this many times as often as the largest one.
REPEATS = 1.25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), ["doc_id"])
    return coded.select(
        "doc_id",
        "coded.n_tokens",
        F.sha2(F.array_join(F.col("coded.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pii.fit(docs)
    found = docs.select("doc_id", pii.find(F.col("text"), model).alias("found"))
    counts = [F.col(f"found.n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("found.base", 256).alias("base_sha256"), F.col("found.spans"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hnsw.nearest(embeddings, embeddings.filter("vec_id % 100 = 0"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, repeats=REPEATS).select("doc_id", "source", "copy", "turn")


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_table(spark, sf_dir, "documents"), _fold(7) == 2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").filter(_fold(5) != 0))
    scored = docs.select("doc_id", (_fold(5) == 0).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.coalesce(_fold(7) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    changed = F.when(tampered, merkle.document_leaf(docs, F.col("n_chars") + 1))
    own = F.struct("doc_id", changed.alias("changed"))
    made = merkle.manifest(docs, merkle.document_leaf(docs), F.col("lang"), [F.col("doc_id")], own)
    folded = merkle.folded(F.coalesce("own.changed", "digest"), F.col("path"))
    proved = merkle.proofs(made).select(
        "own.doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_bpe, op2_url_filter, op3_token_counts, op4_quality_rules, op5_simhash, op6_pii, op7_hnsw, op8_mixing,
        op9_pitman_yor, op10_toxicity, op11_repeats, op12_whitening, op13_merkle,
    )
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    """SQL has no XXH64, tokenizers, trained models, samplers or eigenvectors; tests/llm has brute-force versions of the rest."""
    return dict(sql.ORACLE)
