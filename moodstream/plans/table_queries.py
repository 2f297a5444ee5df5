"""Every operator as a query over the given tables: ``name -> (spark, folder) -> DataFrame``.

Queries about texts alone read ``documents``; those that need authors or times join ``events``.
Float results are rounded, because a distributed sum adds in no fixed order.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodstream.functions import scoring, text
from moodstream.functions.wordlists import NEGATIVE_WORDS, POSITIVE_WORDS, stop_words
from moodstream.operators import (
    changes,
    explore,
    ingest,
    labellers,
    labels,
    learn,
    lexicon,
    models,
    polarity,
    posts,
    topics,
    trends,
    vote,
)
from moodstream.plans import serve
from moodstream.plans.analyze import analyze
from moodstream.schemas import CORRUPT
from moodstream.session import on_all_cores, scratch, use_streaming_state, use_utc, written
from moodstream.sources import events, lake, testtables as t
from moodstream.streaming import copies, jobs, keyed, late as late_posts, state

Query = Callable[[SparkSession, str], DataFrame]

BATCHES = 4
SKETCH = 200
# Fixed points in time for the period queries: just after the last event, and a month later.
AFTER_LAST_EVENT = 1706659200
MONTH_LATER = 1709251200

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query; the given tables hold times in UTC, so it runs in that session zone."""

    @functools.wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(use_utc(spark), folder)

    QUERIES[function.__name__] = run
    return run


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: F.round(name, 6) for name in names})


def _fields(frame: DataFrame, key: str, prediction: Column) -> DataFrame:
    return frame.select(key, prediction.alias("_p")).select(key, "_p.*")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return t.documents(spark, folder).select("doc_id", "text")


# Ingest


@query
def ingest_events(spark, folder):
    decoded = ingest.decode_events(t.event_json(spark, folder))
    return ingest.new_posts(ingest.good_events(decoded))


@query
def quarantine(spark, folder):
    """Lines cut in the middle for one event type: counted as corrupt, the rest as events."""
    lines = t.event_json(spark, folder)
    cut = lines.withColumn(
        "value",
        F.when(F.col("value").contains('"operation":"delete"'), F.expr("left(value, length(value) - 9)"))
        .otherwise(F.col("value")),
    )
    return ingest.decode_events(cut).agg(
        F.count_if(F.col(CORRUPT).isNotNull()).alias("corrupt"),
        F.count_if(F.col(CORRUPT).isNull()).alias("good"),
    )


@query
def lang_filter(spark, folder):
    kept = t.nested_events(spark, folder).where(ingest.speaks("en"))
    return kept.select(F.col("commit.rkey").alias("id"))


@query
def sample_hash(spark, folder):
    keyed = t.documents(spark, folder).select(F.col("doc_id").cast("string").alias("id"), "source")
    return ingest.hash_sample(keyed)


@query
def text_bounds(spark, folder):
    return t.documents(spark, folder).select("doc_id", ingest.text_in_bounds().alias("in_bounds"))


@query
def jsonl_roundtrip(spark, folder):
    path = scratch(spark, "posts-json")
    lake.append_json(t.posts(spark, folder), path)
    good, _ = events.read_posts(spark, path)
    return good


@query
def cold_history(spark, folder):
    path = scratch(spark, "cold")
    lake.append_cold(t.scored_posts(spark, folder), path, rebalance=True)
    return (
        lake.read_cold(spark, path)
        .groupBy("date", F.col("sentiment.label").alias("label"))
        .agg(F.count(F.lit(1)).alias("posts"))
    )


@query
def batch_dedup(spark, folder):
    """Each post written twice, kept once."""
    narrow = t.posts(spark, folder).select("did", "id", "timestamp")
    return ingest.distinct_posts(narrow.unionByName(narrow))


# Text


@query
def clean_text(spark, folder):
    return t.page_texts(spark, folder).select("id", text.clean_text("text").alias("cleaned"))


@query
def clean_text_strict(spark, folder):
    strict = text.clean_text(
        "text", remove_hashtags=True, remove_numbers=True, remove_punctuation=True
    )
    return t.page_texts(spark, folder).select("id", strict.alias("cleaned"))


@query
def preview_text(spark, folder):
    return t.documents(spark, folder).select("doc_id", text.preview("text").alias("preview"))


@query
def word_tokens(spark, folder):
    """Words are counted inside each row: nothing is shuffled."""
    counted = F.explode(text.histogram(text.topic_tokens("text", stop_words()))).alias("c")
    rows = _texts(spark, folder).select("doc_id", counted)
    return rows.select("doc_id", "c.word", F.col("c.n").alias("occurrences"))


# Scoring


@query
def keyword_sentiment(spark, folder):
    return _fields(_texts(spark, folder), "doc_id", scoring.keyword_prediction("text"))


@query
def polarity_label(spark, folder):
    said = F.when(F.col("event_type") != "error", F.col("props")).otherwise("")
    scored = scoring.polarity_sentiment(said, t.event_polarity())
    return _rounded(_fields(t.table(spark, folder, "events"), "event_id", scored), "score")


@query
def polarity_confidence(spark, folder):
    """Errors have no polarity, logins no subjectivity, and a tenth of the rows a blank text."""
    subjectivity = F.get_json_object("props", "$.k").cast("double") / 100
    subjectivity = F.when(F.col("event_type") != "login", subjectivity)
    polarity = F.when(F.col("event_type") != "error", t.event_polarity())
    said = F.when(F.col("event_id") % 10 == 0, "  ").otherwise(F.col("props"))
    predicted = t.table(spark, folder, "events").select(
        "event_id", scoring.polarity_prediction(polarity, subjectivity, said).alias("p")
    )
    return predicted.select("event_id", "p.*", scoring.polarity_value("p").alias("numeric"))


@query
def polarity_lexicon(spark, folder):
    learned = written(t.lexicon_of_labels(spark, folder), "lexicon")
    scored = lexicon.lexicon_scores(_texts(spark, folder), learned, key="doc_id")
    named = scored.select(
        "doc_id", "polarity", "subjectivity",
        scoring.label_by_threshold(F.round("polarity", 6), scoring.POLARITY_THRESHOLD).alias("label"),
    )
    return _rounded(named, "polarity", "subjectivity")


RULES = (["that", "les", "und"], {"the": 1.3, "and": 0.5, "est": 1.5})


@query
def polarity_rules(spark, folder):
    """Polarity with negation and intensifiers; common words of the texts stand for them."""
    learned = written(t.lexicon_of_labels(spark, folder), "lexicon")
    rules = polarity.rule_frame(spark, *RULES)
    return _rounded(polarity.ruled_scores(_texts(spark, folder), learned, rules, key="doc_id"), "polarity")


@query
def star_sentiment(spark, folder):
    rating = F.when(F.col("event_type") == "error", "n/a").otherwise(
        F.concat((F.col("event_id") % 5 + 1).cast("string"), F.lit(" stars"))
    )
    predicted = t.table(spark, folder, "events").select(
        "event_id", scoring.star_prediction(rating, F.col("value") / 503).alias("p")
    )
    return predicted.select("event_id", "p.*", scoring.star_value("p.raw_stars").alias("numeric"))


@query
def prob_score(spark, folder):
    positive = F.col("value") / 503
    both = F.create_map(F.lit("positive"), positive, F.lit("negative"), 1 - positive)
    known = F.when(F.col("event_type") == "error", F.map_filter(both, lambda name, _: name == "negative"))
    return t.table(spark, folder, "events").select(
        "event_id", scoring.probability_value(known.otherwise(both)).alias("score")
    )


def _voted(spark, folder):
    """Every thirteenth text counts as blank; only that flag, not the text, goes through the joins."""
    blank = (F.col("doc_id") % 13 == 0) | text.is_blank("text")
    flagged = t.documents(spark, folder).select("doc_id", blank.alias("blank"))
    joined = vote.join_predictions(flagged, t.predictions(spark, folder), "doc_id")
    return vote.vote(joined, blank=F.col("blank"))


@query
def ensemble_vote(spark, folder):
    v = _voted(spark, folder)
    return v.select(
        "doc_id", "vote.label", "vote.confidence", "vote.score", "vote.error",
        F.array_join("vote.warnings", "; ").alias("warnings"),
    )


@query
def ensemble_breakdown(spark, folder):
    part = F.col("vote.breakdown")
    return _voted(spark, folder).select(
        "doc_id",
        *[
            part.getItem(model).getField(field).alias(f"{model}_{field}")
            for model in vote.WEIGHTS
            for field in ("label", "confidence", "weight")
        ],
    )


def _keyword_stars(column: Column) -> Column:
    stars = (scoring.keyword_lean(column) * 2 + 3).cast("string")
    return scoring.star_prediction(F.concat(stars, F.lit(" stars")), F.lit(0.9))


def _positive_share(column: Column) -> Column:
    """A stand-in for a trained forest: sure of what the keywords say."""
    lean = scoring.keyword_lean(column)
    label = F.when(lean > 0, "positive").when(lean < 0, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), F.lit(0.7).alias("confidence"))


def _analyzed(frame: DataFrame) -> DataFrame:
    return frame.select(
        "doc_id", "original_text", "cleaned_text", "label", "confidence", "score", "error",
        F.array_join("warnings", "; ").alias("warnings"),
    )


@query
def analyze_posts(spark, folder):
    """All three models; every text comes back."""
    models = {"bert": _keyword_stars, "lstm": scoring.keyword_prediction, "rf": _positive_share}
    return _analyzed(analyze(_texts(spark, folder), models))


@query
def analyze_default(spark, folder):
    """The one model that needs nothing, without a bound on the length."""
    return _analyzed(analyze(_texts(spark, folder), longest=None))


def _keyword_model(positive: list[str], negative: list[str]):
    """A stand-in for a user's star model, loaded inside the Python worker."""

    def load():
        def rate(texts):
            rows = []
            for said in texts:
                lowered = said.lower()
                lean = sum(w in lowered for w in positive) - sum(w in lowered for w in negative)
                rows.append((f"{3 + 2 * ((lean > 0) - (lean < 0))} stars", 0.9))
            return rows

        return rate

    return load


@query
def model_scorer(spark, folder):
    scored = models.score_with_model(
        _texts(spark, folder),
        _keyword_model(POSITIVE_WORDS, NEGATIVE_WORDS),
    )
    return scored.select("doc_id", "bert.*")


WINDOW_WORDS, WINDOW_STEP = 64, 48


def _window_model():
    return lambda texts: [sum("e" in word for word in part.split()) / len(part.split()) for part in texts]


@query
def model_windows(spark, folder):
    """A model that takes 64 words at a time, over whole texts in overlapping windows."""
    scored = models.score_long_texts(
        _texts(spark, folder), _window_model, key="doc_id", size=WINDOW_WORDS, step=WINDOW_STEP
    )
    return scored.withColumns({name: F.round(name, 12) for name in ("score", "lowest", "highest")})


# Labels and totals


@query
def label_distribution(spark, folder):
    return labels.label_distribution(t.scored_documents(spark, folder))


@query
def label_percent(spark, folder):
    shares = labels.with_percentages(labels.label_distribution(t.scored_documents(spark, folder)))
    return _rounded(shares, "positive_pct", "negative_pct", "neutral_pct")


def _label_parts(spark, folder):
    scored = t.scored_documents(spark, folder).withColumn("batch_id", F.col("doc_id") % BATCHES)
    return labels.label_counts(scored, by=("batch_id",))


@query
def stats_cumulative(spark, folder):
    return labels.running_totals(_label_parts(spark, folder), block=2)


@query
def stats_latest(spark, folder):
    return labels.latest_totals(labels.running_totals(_label_parts(spark, folder)))


@query
def api_stats(spark, folder):
    return labels.distribution_of_counts(_label_parts(spark, folder))


@query
def stat_cards(spark, folder):
    return labels.stat_cards(labels.label_distribution(t.scored_documents(spark, folder)))


@query
def dominant_mood(spark, folder):
    return labels.mood(labels.label_distribution(t.scored_documents(spark, folder)))


# Trends


@query
def trend_minute(spark, folder):
    return _rounded(trends.trend(t.scored_posts(spark, folder), "minute"), "avg_score")


@query
def trend_hour(spark, folder):
    return _rounded(_hourly(spark, folder), "avg_score")


def _hourly(spark, folder):
    return trends.trend(t.scored_events(spark, folder), "hour")


@query
def trend_merge(spark, folder):
    """Partials of four batches, folded."""
    batched = t.scored_events(spark, folder).withColumn("batch_id", F.pmod(F.hash("id"), F.lit(BATCHES)))
    parts = trends.trend_partials(batched, "hour", by=("batch_id",))
    return _rounded(trends.merge_trends(parts), "avg_score")


@query
def trends_period(spark, folder):
    chosen = trends.trend_in_period(t.scored_events(spark, folder), "1w", AFTER_LAST_EVENT, "hour")
    return _rounded(chosen, "avg_score")


@query
def trends_period_fallback(spark, folder):
    """No bucket is this recent, so the whole series comes back."""
    chosen = trends.in_period_or_all(_hourly(spark, folder), "24h", MONTH_LATER)
    return _rounded(chosen, "avg_score")


@query
def trend_direction(spark, folder):
    return _rounded(trends.trend_direction(_hourly(spark, folder)), "avg_score")


@query
def chart_series(spark, folder):
    return trends.chart_series(_hourly(spark, folder))


@query
def chart_trend(spark, folder):
    return trends.chart_trend(trends.chart_series(_hourly(spark, folder)))


@query
def trend_rolling(spark, folder):
    rolled = trends.rolling(trends.trend_partials(t.scored_events(spark, folder), "hour"), "hour", 24, 96)
    return _rounded(rolled, "avg_score", "rolling_avg", "z_score")


@query
def trend_summary(spark, folder):
    week = trends.trend_in_period(t.scored_events(spark, folder), "1w", AFTER_LAST_EVENT, "hour")
    return _rounded(trends.summary(written(week, "week")), "latest_avg", "min_avg", "max_avg")


@query
def trend_changes(spark, folder):
    """Cumulative sums of the hourly series and where they pass the limit, in chunks of four days."""
    parts = trends.trend_partials(t.scored_events(spark, folder), "hour")
    found = changes.change_points(parts, "hour", target=0.0, slack=0.02, limit=0.15, chunk=96)
    return _rounded(found, "avg_score", "upper", "lower")


# Posts


def _newest(spark, folder, n=posts.STORED):
    keys = t.documents(spark, folder).select("doc_id").join(t.authors(spark, folder), "doc_id")
    keys = keys.withColumn("id", F.col("doc_id").cast("string"))
    texts = t.documents(spark, folder).select("doc_id", "source", "text")
    chosen = posts.latest_with_details(keys, texts, n, on="doc_id")
    return posts.stored_form(scoring.score_texts(chosen))


@query
def recent_posts(spark, folder):
    return _newest(spark, folder)


@query
def recent_posts_distinct(spark, folder):
    """Every post written twice: the newest distinct ones."""
    flat = t.posts(spark, folder)
    chosen = posts.latest_distinct(flat.unionByName(flat), posts.STORED)
    return posts.stored_form(scoring.score_texts(chosen))


@query
def latest_posts(spark, folder):
    served = posts.served_posts(_newest(spark, folder))
    return served.select("id", "title", "subreddit", "sentiment.*")


@query
def post_feed(spark, folder):
    served = posts.served_posts(_newest(spark, folder))
    emptied = served.withColumn("title", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("title")))
    return posts.post_feed(emptied.withColumn("subreddit", F.nullif("subreddit", F.lit("src1"))))


# Topics


def _counts(spark, folder):
    return topics.topic_counts(t.scored_documents(spark, folder))


@query
def topic_counts(spark, folder):
    return _counts(spark, folder)


@query
def topic_counts_cleaned(spark, folder):
    """Links and mentions removed before the words are cut."""
    scored = scoring.score_texts(t.page_texts(spark, folder))
    return topics.topic_counts(scored, clean_first=True)


@query
def topics_top100(spark, folder):
    return topics.top_topics(_counts(spark, folder))


@query
def topics_dedup(spark, folder):
    return topics.trending_topics(t.scored_documents(spark, folder))


@query
def api_topics(spark, folder):
    return topics.served_topics(topics.trending_topics(t.scored_documents(spark, folder)))


@query
def topic_bars(spark, folder):
    return topics.topic_bars(topics.served_topics(topics.trending_topics(t.scored_documents(spark, folder))))


@query
def word_cloud(spark, folder):
    return _rounded(explore.word_cloud(_texts(spark, folder)), "weight")


@query
def ngram_counts(spark, folder):
    return explore.ngram_counts(_texts(spark, folder))


@query
def tfidf_keywords(spark, folder):
    return explore.tfidf_keywords(_texts(spark, folder), key="doc_id")


# Streaming


BAD_LINES = ['{"id": "7", "text": "cut', "", '{"did": "u1", "timestamp": 5.0, "text": "no id"}',
             '{"id": "8", "did": "u1", "text": "no time"}', "not json at all"]


def _kept_state(spark, folder, **scoring_options):
    """A run over three arrivals of JSON files: half of the posts, only bad lines, then the rest."""
    path, root, checkpoint = (scratch(spark, name) for name in ("arrivals", "state", "checkpoint"))
    arriving = t.posts(spark, folder)
    late = F.pmod(F.hash("id"), F.lit(2)) == 1
    bad = spark.createDataFrame([(line,) for line in BAD_LINES], "value string")

    def work_off() -> None:
        stream = events.parsed_post_stream(spark, path)
        jobs.keep_state(stream, root, checkpoint, once=True, **scoring_options).awaitTermination()

    lake.append_json(arriving.where(~late), path)
    work_off()
    bad.coalesce(1).write.mode("append").text(path)
    work_off()
    lake.append_json(arriving.where(late), path)
    work_off()
    return root


@query
def stream_ingest(spark, folder):
    raw, out = scratch(spark, "raw"), scratch(spark, "lake")
    t.event_json(spark, folder).write.text(raw)
    arriving = jobs.post_stream_of(events.event_line_stream(spark, raw))
    jobs.write_lake(arriving, out, scratch(spark, "checkpoint"), once=True).awaitTermination()
    return events.read_posts(spark, out)[0]


@query
def stream_totals(spark, folder):
    return serve.stats(spark, _kept_state(spark, folder))


@query
def stream_trend(spark, folder):
    """Per-batch partials: the second arrival updates minutes the first one had touched."""
    return _rounded(state.trends(spark, _kept_state(spark, folder)), "avg_score")


@query
def stream_quarantine(spark, folder):
    """Lines set aside by reason, and the posts kept."""
    root = _kept_state(spark, folder)
    bad = spark.read.schema("reason string, line string").parquet(f"{root}/quarantine")
    counted = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
    kept = serve.stats(spark, root).select(F.lit("kept").alias("reason"), F.col("total").alias("lines"))
    return counted.unionByName(kept)


@query
def stream_lexicon_totals(spark, folder):
    """Labels by text polarity, as the stream's own scorer."""
    learned = written(t.lexicon_of_labels(spark, folder), "lexicon")
    return serve.stats(spark, _kept_state(spark, folder, frame_scorer=lexicon.lexicon_sentiment(learned)))


@query
def served_posts(spark, folder):
    served = serve.latest_posts(spark, _kept_state(spark, folder))
    return served.select("id", "title", "subreddit", "sentiment.*")


@query
def served_topics(spark, folder):
    return serve.topics(spark, _kept_state(spark, folder))


@query
def served_stats(spark, folder):
    """The stored totals, read as SQL; their stamp is set."""
    state.register_views(spark, _kept_state(spark, folder))
    return spark.sql("""SELECT total_count, round(positive_pct, 6) AS positive_pct, round(negative_pct, 6) AS negative_pct,
        round(neutral_pct, 6) AS neutral_pct, updated_at <= now() AS stamped FROM sentiment_stats""")


@query
def served_trends(spark, folder):
    return _rounded(serve.trends(spark, _kept_state(spark, folder), "1w", AFTER_LAST_EVENT), "avg_score")


@query
def served_summary(spark, folder):
    overview = serve.trend_overview(spark, _kept_state(spark, folder), "1w", AFTER_LAST_EVENT)
    return _rounded(overview, "latest_avg", "min_avg", "max_avg")


@query
def stream_windows(spark, folder):
    """The same series from Spark's windowed state, in update mode: the newest row of a window wins."""
    use_streaming_state(spark)
    path, out = scratch(spark, "arrivals"), scratch(spark, "windows")
    lake.append_json(t.posts(spark, folder), path)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    series = jobs.windowed_trend(events.post_stream(spark, path))
    writer = series.writeStream.outputMode("update").foreachBatch(keep)
    jobs.start(writer, scratch(spark, "checkpoint"), once=True).awaitTermination()
    emitted = spark.read.parquet(out)
    newest = emitted.groupBy("time").agg(F.max_by(F.struct("avg_score", "count"), "batch_id").alias("row"))
    return _rounded(newest.select("time", "row.*"), "avg_score")


@query
def stream_dedup(spark, folder):
    use_streaming_state(spark)
    path, out = scratch(spark, "arrivals"), scratch(spark, "distinct")
    arriving = t.posts(spark, folder)
    lake.append_json(arriving, path)
    lake.append_json(arriving, path)
    distinct = jobs.without_copies(events.post_stream(spark, path))
    writer = distinct.select("did", "id", "source").writeStream.format("parquet").option("path", out)
    jobs.start(writer, scratch(spark, "checkpoint"), once=True).awaitTermination()
    return spark.read.parquet(out)


@query
def hot_sql(spark, folder):
    """A parameterised SELECT over the hot tables of a finished stream."""
    state.register_views(spark, _kept_state(spark, folder))
    return spark.sql(
        "SELECT time, round(avg_score, 6) AS avg_score, count FROM hourly_trends "
        "WHERE count >= :least ORDER BY time",
        args={"least": 2},
    )


def _stopped_run(spark, folder):
    """Three whole batches, and a fourth that was stopped after some of its tables."""
    root = scratch(spark, "state")
    arriving = written(t.posts(spark, folder).withColumn("batch", _batch_of("id")), "posts")
    for number in range(BATCHES - 1):
        state.update_state(arriving.where(F.col("batch") == number).drop("batch"), root, number, sketch=SKETCH)
    last = arriving.where(F.col("batch") == BATCHES - 1).drop("batch")
    last = last.withColumn("sentiment", scoring.keyword_sentiment("text"))
    lake.write_cold_batch(last, f"{root}/cold", BATCHES - 1)
    state.write_trend_parts(trends.trend_partials(last, "minute"), root, BATCHES - 1)
    state.write_parts(topics.topic_counts(last), root, "topic_parts", BATCHES - 1)
    return root


def _batch_of(key: str) -> Column:
    return F.pmod(F.col(key).cast("int"), F.lit(BATCHES))


@query
def snapshot_state(spark, folder):
    """All tables of one version tell of the same posts: the newest one, and the first batch alone."""
    root = _stopped_run(spark, folder)
    found = None
    for version in (None, 0):
        at = state.snapshot(spark, root, version)
        parts = [
            at.parts("label_parts").groupBy("label").agg(F.sum("n").alias("n")).select(F.lit("posts").alias("table"), "label", "n"),
            at.trends().agg(F.sum("count").alias("n")).select(F.lit("trend"), F.lit(""), "n"),
            at.parts("topic_parts").groupBy("label").agg(F.sum("count").alias("n")).select(F.lit("words"), "label", "n"),
            at.cold().agg(F.count(F.lit(1)).alias("n")).select(F.lit("cold"), F.lit(""), "n"),
            at.latest_posts().agg(F.count(F.lit(1)).alias("n")).select(F.lit("latest"), F.lit(""), "n"),
        ]
        rows = functools.reduce(DataFrame.union, parts).withColumn("version", F.lit(at.version))
        found = rows if found is None else found.union(rows)
    return found


@query
def topic_sketch(spark, folder):
    """Heavy words of a run from the sketches of its batches, beside the exact counts."""
    at = state.snapshot(spark, _stopped_run(spark, folder))
    exact = at.parts("topic_parts").groupBy("word", "label").agg(F.sum("count").alias("exact"))
    found = state.topic_bounds(spark, at.root, SKETCH, version=at.version)
    return found.join(exact, ["word", "label"]).withColumn("inside", F.col("exact").between(F.col("low"), F.col("high")))


@query
def stream_dedup_run(spark, folder):
    """Posts that come again in later runs, days after the first copy and under another time."""
    path, root, out, checkpoint = (scratch(spark, name) for name in ("arrivals", "seen", "distinct", "checkpoint"))
    arriving = written(t.posts(spark, folder), "posts")
    late = F.pmod(F.hash("id"), F.lit(2)) == 1
    again = arriving.withColumn("timestamp", F.col("timestamp") + 3 * 86400)
    for delivery in (arriving.where(~late).union(again.where(~late)), again, arriving):
        lake.append_json(delivery, path, compression="gzip")
        copies.keep_first_copies(events.post_stream(spark, path), root, out, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(out).select("did", "id", "source", "text")


KEPT_POSTS = 5


@query
def stream_keyed_state(spark, folder):
    """Totals and newest posts of each source after two runs; the newest row of a source is its state."""
    path, out, checkpoint = (scratch(spark, name) for name in ("arrivals", "sources", "checkpoint"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    arriving = written(t.posts(spark, folder), "posts")
    for rest in (1, 0):
        lake.append_json(arriving.where(F.col("id").cast("long") % 2 == rest), path)
        series = keyed.source_state(events.post_stream(spark, path), keep=KEPT_POSTS)
        writer = series.writeStream.outputMode("update").foreachBatch(keep)
        jobs.start(writer, checkpoint, once=True).awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.groupBy("source").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "source"]), "batch_id").alias("row"))
    state_now = last.select("source", "row.*").withColumn("newest", F.array_join(F.transform("newest", lambda p: p["id"]), ","))
    return _rounded(state_now.select("source", "total", *scoring.LABELS, "sum_score", "newest"), "sum_score")


LATE_DELAY = 5 * 86400


@query
def stream_late(spark, folder):
    """Every post, on time or late: the second run brings old posts."""
    path, root, checkpoint = (scratch(spark, name) for name in ("arrivals", "split", "checkpoint"))
    arriving = written(t.posts(spark, folder), "posts")
    for rest in (0, 1):
        lake.append_json(arriving.where(F.col("id").cast("long") % 2 == rest), path)
        late_posts.keep_late(events.post_stream(spark, path), root, checkpoint, delay=LATE_DELAY, once=True).awaitTermination()
    on_time = spark.read.parquet(f"{root}/on_time").select("id", F.lit(False).alias("late"), F.lit(None).cast("double").alias("seconds_late"))
    late = spark.read.parquet(f"{root}/late").select("id", F.lit(True).alias("late"), F.round("seconds_late", 3).alias("seconds_late"))
    return on_time.unionByName(late)


@query
def empty_batches(spark, folder):
    """Batches without posts, or with bad lines alone, commit nothing and move no answer."""
    root = scratch(spark, "state")
    arriving = t.posts(spark, folder)
    for number, batch in enumerate((arriving.limit(0), arriving, arriving.limit(0))):
        state.update_state(batch, root, number)
    whole = state.committed(spark, root).select(F.col("batch_id").alias("batch"), "posts")
    return whole.join(state.totals(spark, root), F.col("posts") == F.col("total"))


# Learning


@query
def rf_reload(spark, folder):
    """A forest read back from disk predicts what it predicted before."""
    rows, path = on_all_cores(_training(spark, folder)), scratch(spark, "forest")
    model = learn.train(rows, stop=stop_words())
    learn.save(model, path)
    said = learn.predict(model, on_all_cores(_texts(spark, folder)))
    said = written(learn.predict(learn.load(path), said, into="again").select("doc_id", "rf", "again"), "said")
    both = said.select("doc_id", "rf").join(said.select("doc_id", "again"), "doc_id")
    return both.select("doc_id", (F.to_json("rf") == F.to_json("again")).alias("same"))


@query
def weak_labels(spark, folder):
    return learn.weak_labels(_texts(spark, folder)).select("doc_id", "label")


LABEL_ROUNDS = 2


@query
def label_model(spark, folder):
    """One label from three models' labels, their reliability learned without true labels."""
    said = [
        frame.select("doc_id", F.lit(name).alias("labeller"), "label") for name, frame in t.predictions(spark, folder).items()
    ]
    items = written(labellers.gathered(functools.reduce(DataFrame.unionByName, said), "doc_id"), "votes")
    model = labellers.fit(items, rounds=LABEL_ROUNDS)
    found = labellers.combined(items, model).select("doc_id", "label", "confidence")
    return _rounded(found, "confidence")


@query
def labelled_texts(spark, folder):
    labelled = learn.attach_labels(
        t.documents(spark, folder).select("doc_id", "text"), t.true_labels(spark, folder), "doc_id"
    )
    return labelled.select("doc_id", "label", F.length("text").cast("long").alias("n_chars"))


def _training(spark, folder):
    texts = t.documents(spark, folder).select("doc_id", "text")
    return written(learn.attach_labels(texts, t.true_labels(spark, folder), "doc_id"), "training")


@query
def rf_train_metrics(spark, folder):
    """Samples, vocabulary size, and whether the forest does at least as well as the commonest label."""
    rows = on_all_cores(_training(spark, folder))
    metrics = learn.training_metrics(learn.train(rows, stop=stop_words()), rows)
    commonest = rows.groupBy("label").count().agg(F.max("count").alias("n"))
    better = F.col("training_accuracy") >= F.round(F.col("n") / F.col("samples"), 4)
    return metrics.crossJoin(F.broadcast(commonest)).select("samples", "features", better.alias("beats_commonest"))


def _forest_predictions(spark, folder):
    texts = on_all_cores(_texts(spark, folder))
    said = texts.withColumn("text", F.when(F.col("doc_id") % 13 == 0, " ").otherwise(F.col("text")))
    model = learn.train(on_all_cores(_training(spark, folder)))
    return learn.probability_scores(learn.predict(model, said))


@query
def rf_predict(spark, folder):
    """What holds of every prediction: label known, shares add up, the surest label wins, blank rule."""
    shares = F.map_values("rf.probabilities")
    total = F.aggregate(shares, F.lit(0.0), lambda sum_, p: sum_ + p)
    blank = F.col("doc_id") % 13 == 0
    return _forest_predictions(spark, folder).select(
        "doc_id",
        F.col("rf.label").isin(*scoring.LABELS).alias("label_known"),
        (F.abs(total - 1) < 0.001).alias("adds_up"),
        F.when(blank, F.col("rf.confidence") == 0)
        .otherwise(F.abs(F.array_max(shares) - F.col("rf.confidence")) < 1e-9).alias("surest"),
        (F.col("score").between(-1, 1)).alias("score_in_range"),
        F.col("rf.error").alias("error"),
        F.when(blank, F.col("rf.label")).alias("blank_label"),
    )


@query
def tfidf_features(spark, folder):
    """Per term of the vocabulary: rows that hold it, and its weight over all rows."""
    return _rounded(learn.term_weights(_training(spark, folder)), "idf")


@query
def lda_topics(spark, folder):
    """Per topic: terms listed, terms that are words of the texts, falling weights."""
    listed = explore.lda_topics(_texts(spark, folder))
    listed = written(listed, "topics")
    held = F.explode(F.array_distinct(text.topic_tokens("text", stop_words()))).alias("term")
    words = _texts(spark, folder).select(held).groupBy("term").count()
    known = listed.join(words.where("count >= 2"), "term", "left")
    order = Window.partitionBy("topic").orderBy("rank")
    falls = F.coalesce(F.lag("weight").over(order) >= F.col("weight"), F.lit(True))
    return known.withColumn("falls", falls).groupBy("topic").agg(
        F.count(F.lit(1)).alias("terms"), F.count("count").alias("known"), F.bool_and("falls").alias("ordered")
    )
