"""Documents to packed training sequences in five stages, each written as Parquet before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.llm import edited_copies, mixing, packing, secret_scan, toxicity
from moodstream.llm.queries import word_tokenizer
from moodstream.llm.shared import held_out, table
from moodstream.session import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the cut, by a model of the labelled ones that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    scored = toxicity.tag(docs, model)
    return scored.where(F.col("score") < toxicity.CUT).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return edited_copies.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text."""
    forest, words = secret_scan.fit(docs)
    masked = secret_scan.redact(secret_scan.scan(docs, forest, words))
    changed = F.size("secrets") > 0
    length = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows left out, kept or repeated."""
    return mixing.resample(docs, seed="mix")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 token ids."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages hash shingles, grow models and tokenize; SQL has none of it.  The tests compare with
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
