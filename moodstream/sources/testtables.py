"""Posts, events and model outputs derived from the given star-schema and text tables.

Scoring runs on ``documents`` before the join with ``events``, so a job that needs only times and
scores shuffles no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.functions.scoring import Scorer, keyword_sentiment
from moodstream.functions.text import tokens

CREATED_AT = "yyyy-MM-dd'T'HH:mm:ss"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; its times are read as UTC if the session zone is UTC (``session.use_utc``)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _event_micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def authors(spark: SparkSession, folder: str) -> DataFrame:
    """Who posted each document, and when."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("doc_id"),
        F.concat(F.lit("u"), "user_id").alias("did"),
        (_event_micros() / 1e6).alias("timestamp"),
        F.date_format("ts", CREATED_AT).alias("created_at"),
    )


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Flat posts: each document with its author and time."""
    texts = documents(spark, folder).select("doc_id", "source", "text")
    return _as_posts(texts.join(authors(spark, folder), "doc_id"), "text")


def scored_posts(
    spark: SparkSession, folder: str, scorer: Scorer = keyword_sentiment
) -> DataFrame:
    """Flat posts with their sentiment; the text is scored where it is scanned."""
    texts = scored_documents(spark, folder, scorer)
    return _as_posts(texts.join(authors(spark, folder), "doc_id"), "text", "sentiment")


def _as_posts(joined: DataFrame, *more: str) -> DataFrame:
    return joined.select(
        F.col("doc_id").cast("string").alias("id"), "did", "source", "timestamp", "created_at", *more
    )


def scored_documents(
    spark: SparkSession, folder: str, scorer: Scorer = keyword_sentiment
) -> DataFrame:
    texts = documents(spark, folder).select("doc_id", "lang", "source", "text")
    return texts.withColumn("sentiment", scorer(F.col("text")))


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a scored row: its value rescaled to a score."""
    score = event_polarity()
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"),
        (_event_micros() / 1e6).alias("timestamp"),
        F.struct(F.lit("").alias("label"), score.alias("score")).alias("sentiment"),
    )


def event_polarity() -> Column:
    """Event value on the scale -1 … 1 (values reach about 500)."""
    return F.col("value") / 251 - 1


def nested_events(spark: SparkSession, folder: str) -> DataFrame:
    """The raw event shape: kinds, operations, languages and empty texts vary with the rows."""
    texts = documents(spark, folder).select("doc_id", "lang", "text")
    joined = texts.join(table(spark, folder, "events"), F.col("doc_id") == F.col("event_id"))
    record = F.struct(
        F.when(F.col("doc_id") % 17 != 0, F.array("lang")).alias("langs"),
        F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text")).alias("text"),
        F.date_format("ts", CREATED_AT).alias("createdAt"),
    )
    return joined.select(
        F.when(F.col("event_type") == "error", "identity").otherwise("commit").alias("kind"),
        F.concat(F.lit("u"), "user_id").alias("did"),
        _event_micros().alias("time_us"),
        F.struct(
            F.when(F.col("event_type") == "signup", "delete").otherwise("create").alias("operation"),
            F.col("doc_id").cast("string").alias("rkey"),
            record.alias("record"),
        ).alias("commit"),
    )


def event_json(spark: SparkSession, folder: str) -> DataFrame:
    """Nested events as one JSON document per row."""
    return nested_events(spark, folder).select(
        F.to_json(F.struct("kind", "did", "time_us", "commit")).alias("value")
    )


def true_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Sentiment label per labelled document."""
    label = (
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    )
    return table(spark, folder, "labels").select("doc_id", label.alias("label"))


def lexicon_of_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A lexicon learned from the labelled documents; it grows with them."""
    labelled = documents(spark, folder).select("doc_id", "text").join(table(spark, folder, "labels"), "doc_id")
    words = labelled.select("quality", "toxic", F.explode(tokens("text")).alias("word"))
    lean = F.col("quality") - F.col("toxic")
    return (
        words.where(F.length("word") > 4)
        .groupBy("word")
        .agg(F.avg(lean).alias("polarity"), F.avg(F.abs(lean)).alias("subjectivity"))
    )


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, and web pages with their address in front: texts with links, signs and numbers."""
    plain = documents(spark, folder).select("doc_id", "text")
    pages = table(spark, folder, "pages")
    return plain.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(
        pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.concat_ws(" ", "url", "html").alias("text"))
    )


def predictions(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Outputs of three models over the documents; the third one skipped some of them."""
    kinds = F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive"))
    events = table(spark, folder, "events")
    texts = documents(spark, folder).select("doc_id", "text")

    def outcome(step: int) -> list[Column]:
        return [
            F.element_at(kinds, ((F.col("event_id") + F.floor("value") * step) % 3 + 1).cast("int")).alias("label"),
            (F.col("value") / 503).alias("confidence"),
        ]

    lean = keyword_sentiment("text")
    return {
        "bert": events.select(F.col("event_id").alias("doc_id"), *outcome(1)),
        "lstm": texts.select("doc_id", lean.getField("label").alias("label"), F.lit(0.5).alias("confidence")),
        "rf": events.where(F.col("event_type") != "error").select(
            F.col("event_id").alias("doc_id"), *outcome(2)
        ),
    }
