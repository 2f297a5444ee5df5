"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.llm import (
    html_text, language_id, mixing, packing, ranked_search, secret_scan, sharding, simhash, substring_dedup,
    token_alignment, topk, toxicity, vector_dedup,
)
from moodstream.llm.oracle_sql import ORACLES  # noqa: F401
from moodstream.llm.shared import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_tokenizer() -> str:
    return tokenizer_file("word_bpe_49k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_language_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify_documents(table(spark, folder, "documents"))


@query
def op5_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), shards=24, seed="shuffle")


@query
def op6_hilbert_packs(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), word_tokenizer())


@query
def op7_simhash_variants(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


@query
def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(table(spark, folder, "documents"), seed="mix")


@query
def op2_impact_top5(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search_embeddings(table(spark, folder, "embeddings"), k=5, every=50)


@query
def op3_page_articles(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages").select("page_id", "url", "html"))


@query
def op4_vector_groups(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_groups(table(spark, folder, "embeddings"), margin=vector_dedup.PROBED)


@query
def op8_toxic_spans(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op10_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, folder, "documents"))


@query
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return token_alignment.align(documents, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query
def op12_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, folder, "documents"), form="sha256")
    return found.withColumnRenamed("kept", "kept_sha256")


@query
def op13_ranked_items(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)
