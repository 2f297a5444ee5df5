"""Event and post sources, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.operators.ingest import corrupt_lines, decode_events, good_events, split_parsed_posts
from moodstream.schemas import CORRUPT, LINE, POST_OR_CORRUPT


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw event lines of the files below ``path``."""
    return spark.read.text(path)


def event_line_stream(
    spark: SparkSession, path: str, *, files_per_trigger: int | None = None, archive: str | None = None
) -> DataFrame:
    """Raw event lines of files as they appear; the query's checkpoint remembers what was read.

    ``archive`` moves finished files there; it tidies up and is not what prevents double reads.
    """
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.text(path)


def message_stream(spark: SparkSession, source_format: str = "kafka", **options: str) -> DataFrame:
    """Event lines from a message bus whose connector is on the class path."""
    stream = spark.readStream.format(source_format).options(**options).load()
    return stream.select(F.col("value").cast("string").alias("value"))


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decoded events, and the quarantine of lines that are none."""
    decoded = decode_events(event_lines(spark, path))
    return good_events(decoded), corrupt_lines(decoded)


def _parsed_posts(lines: DataFrame) -> DataFrame:
    """Post columns of JSON lines, with the line itself and what could not be read of it."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("value", POST_OR_CORRUPT, options)
    return lines.select(parsed.alias("post"), F.col("value").alias(LINE)).select("post.*", LINE)


def read_posts(spark: SparkSession, path: str, pattern: str = "*.json*") -> tuple[DataFrame, DataFrame]:
    """Flat posts of all JSON-lines files below ``path``, and the quarantine ``(reason, line)``."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    return split_parsed_posts(_parsed_posts(lines))


def parsed_post_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of JSON-lines files as they appear, parsed; bad ones are marked, not dropped.

    ``streaming.jobs.keep_state`` splits them off batch by batch and keeps them.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _parsed_posts(reader.text(path))


def post_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """The good posts of JSON-lines files as they appear."""
    return split_parsed_posts(parsed_post_stream(spark, path, files_per_trigger=files_per_trigger))[0]
