"""The plans stay in the JVM, prune columns, push filters and broadcast only what is bounded."""

import re

import pytest
from pyspark.sql import functions as F

from moodstream.operators import topics, trends
from moodstream.plans.table_queries import QUERIES
from moodstream.schemas import POST
from moodstream.sources import lake, testtables as t
from moodstream.streaming import state

FOLDER = "/root/testdata/sf0.001"
PYTHON = {"model_scorer", "model_windows"}
RUNS_JOBS = {"rf_train_metrics", "rf_predict", "lda_topics", "tfidf_features"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", sorted(n for n in QUERIES if n not in PYTHON | RUNS_JOBS and not n.startswith(("stream_", "hot_", "served_")))
)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


@pytest.mark.parametrize("name", ["recent_posts", "topics_top100", "word_cloud", "trend_direction"])
def test_top_k_is_not_a_global_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, FOLDER))


def test_trend_shuffles_no_text(spark):
    # Larger tables would be joined by a shuffle, so look at what goes through one.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = trends.trend(t.scored_posts(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
        shuffled = plan(trends.trend(t.scored_posts(spark, FOLDER)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = text[: text.index("Join Inner")]
    assert "text#" not in join
    assert "SortMergeJoin" in shuffled


def test_stop_words_are_broadcast_and_counts_combined_early(spark):
    text = plan(topics.topic_counts(t.scored_documents(spark, FOLDER)))
    assert "LeftAnti, BuildRight" in text and "BroadcastExchange" in text
    assert text.count("HashAggregate") == 2


def test_scan_reads_only_needed_columns(spark):
    text = plan(trends.trend(t.scored_events(spark, FOLDER), "hour"))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in text


def test_period_cutoff_reaches_the_scan(spark, tmp_path):
    rows = [("2024-01-01 00:00", 0.1, 1)]
    spark.createDataFrame(rows, "time string, avg_score double, count long").write.parquet(str(tmp_path / "s"))
    series = spark.read.parquet(str(tmp_path / "s"))
    assert "GreaterThanOrEqual(time," in plan(trends.in_period(series, "6h", 1704067200))


def test_one_plan_for_tables_of_any_size(spark):
    """Texts are worked on where they are scanned: nothing deals them out first."""
    for name in ("keyword_sentiment", "word_tokens", "clean_text", "analyze_posts"):
        text = plan(QUERIES[name](spark, FOLDER))
        assert "Exchange" not in text and text.count("Scan parquet") <= 2


def _period_plan(spark, root):
    return state.trends(spark, root, "1d", as_of=86400.0 * 9)._jdf.queryExecution().executedPlan().toString()


def test_period_prunes_the_state_by_day_and_bucket(spark, tmp_path):
    root = str(tmp_path)
    for day in range(10):
        rows = [(str(day), "u", "s", 86400.0 * day + 50, "good day", "c")]
        state.update_state(spark.createDataFrame(rows, POST), root, day)
    text = _period_plan(spark, root)
    filters = re.search(r"PartitionFilters: \[[^\]]*\]", text)[0]
    assert "date" in filters and ">=" in filters and "GreaterThanOrEqual(bucket," in text
    found = state.trends(spark, root, "1d", as_of=86400.0 * 9)
    assert {r.time[:10] for r in found.collect()} == {"1970-01-09", "1970-01-10"}
    day = lake.read_cold(spark, f"{root}/cold", "1970-01-03", "1970-01-03")
    assert [r.id for r in day.collect()] == ["2"] and len(day.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(date" in plan(day)


@pytest.mark.parametrize("name, scans", [
    ("stats_cumulative", 0), ("stats_latest", 0), ("trends_period_fallback", 0), ("word_tokens", 1), ("tfidf_keywords", 3),
])
def test_how_often_tables_are_read(spark, name, scans):
    """What feeds two branches is written first, so the given tables are not read again."""
    text = plan(QUERIES[name](spark, FOLDER))
    assert len(re.findall(r"Scan parquet .*testdata|Location: InMemoryFileIndex.*testdata", text)) <= scans
