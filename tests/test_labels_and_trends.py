import random

import pytest
from pyspark.sql import functions as F

from moodstream.functions import display, timebuckets
from moodstream.operators import labels, trends

SCORED = "id string, timestamp double, sentiment struct<label:string, score:double>"


def scored(spark, rows):
    return spark.createDataFrame([(i, ts, (label, score)) for i, ts, label, score in rows], SCORED)


def test_distribution_of_nothing_is_zero(spark):
    shares = labels.with_percentages(labels.label_distribution(scored(spark, [])))
    assert set(shares.first().asDict().values()) == {0}
    assert labels.mood(labels.label_distribution(scored(spark, []))).first().mood == "Neutral"


@pytest.mark.parametrize(
    "part, whole, percent", [(1, 3, 33), (1, 8, 13), (0, 0, 0), (1, 200, 1), (29, 200, 14), (2, 3, 67)]
)
def test_whole_share(one, part, whole, percent):
    assert one(display.whole_share("a", "b"), "a long, b long", (part, whole)) == percent


@pytest.mark.parametrize("average, score, band", [
    (None, 50, "neutral"), (0.3, 65, "positive"), (-0.2, 40, "negative"), (0.29, 65, "positive"), (-1.0, 0, "negative"),
])
def test_gauge(one, average, score, band):
    got = one(display.gauge_score("a"), "a double", (average,))
    assert got == score
    assert one(display.gauge_band("s"), "s long", (got,)) == band


def test_running_totals_equal_a_plain_prefix_sum(spark):
    rng = random.Random(3)
    rows = [(b, label, rng.randrange(9)) for b in rng.sample(range(3000), 200) for label in labels.SHOWN]
    parts = spark.createDataFrame(rows, "batch_id long, label string, n long")
    got = {r.batch_id: r.asDict() for r in labels.running_totals(parts, block=64).collect()}
    total = dict.fromkeys(labels.SHOWN, 0)
    for batch in sorted({r[0] for r in rows}):
        for b, label, n in rows:
            if b == batch:
                total[label] += n
        assert {k: got[batch][k] for k in labels.SHOWN} == total
        assert got[batch]["total"] == sum(total.values())
    latest = labels.latest_totals(labels.running_totals(parts)).first()
    assert latest.total == sum(total.values())


@pytest.mark.parametrize("epoch, start", [(0.0, "1970-01-01 05:30"), (-0.5, "1970-01-01 05:29"), (59.999, "1970-01-01 05:30")])
def test_minute_bucket_drops_the_fraction_of_the_shifted_time(one, epoch, start):
    assert one(timebuckets.bucket_label(timebuckets.bucket_start("t")), "t double", (epoch,)) == start


def test_trend_counts_ids_and_merging_any_split_equals_one_pass(spark):
    rng = random.Random(5)
    rows = [(str(i), rng.uniform(0, 9000), "neutral", rng.choice([-0.3, 0.0, 0.3])) for i in range(400)]
    frame = scored(spark, rows)
    whole = {r.time: r for r in trends.trend(frame).collect()}
    cut = F.col("id").cast("int") % 7
    pieces = [trends.trend_partials(frame.where(cut == k)) for k in (3, 0, 6, 1, 5, 2, 4)]
    parts = pieces[0]
    for piece in pieces[1:]:
        parts = parts.unionByName(piece)
    merged = {r.time: r for r in trends.merge_trends(parts).collect()}
    assert merged.keys() == whole.keys()
    for time, row in merged.items():
        assert row["count"] == whole[time]["count"]
        assert row.avg_score == pytest.approx(whole[time].avg_score)


def series(spark, *rows):
    return spark.createDataFrame(list(rows), "time string, avg_score double, count long")


@pytest.mark.parametrize("scores, direction, latest", [
    ([], "stable", 0.0),
    ([0.4], "stable", 0.4),
    ([0.0, 0.05], "stable", 0.05),
    ([0.0, 0.0501], "rising", 0.0501),
    ([0.0501, 0.0], "falling", 0.0),
    ([0.9, 0.0, -0.05], "stable", -0.05),
])
def test_direction(spark, scores, direction, latest):
    rows = [(f"2024-01-01 0{2 * i}:00", s, 1) for i, s in enumerate(scores)]
    got = trends.trend_direction(series(spark, *rows)).first()
    assert (got.trend_direction, got.avg_score) == (direction, latest)


def test_summary_of_nothing(spark):
    got = trends.summary(series(spark)).first()
    assert got.asDict() == {"trend_direction": "stable", "latest_avg": 0.0, "min_avg": None, "max_avg": None,
                            "buckets": 0, "posts": 0}


def test_period_filter_and_fallback(spark):
    rows = [(f"2024-01-01 {h:02d}:00", h / 100, h) for h in range(24)]
    frame = series(spark, *rows)
    noon = 1704067200 + 12 * 3600 - 19800  # 12:00 on the shifted clock
    assert [r.time for r in trends.in_period(frame, "6h", noon).collect()] == [r[0] for r in rows[6:]]
    assert trends.in_period(frame, "unknown", noon).first().time == "2024-01-01 11:00"
    assert trends.in_period_or_all(frame, "1h", noon).first().time == "2024-01-01 11:00"
    assert trends.in_period_or_all(frame, "1h", noon + 10**7).count() == 24
    assert trends.in_period_or_all(frame, "All", noon).count() == 24


@pytest.mark.parametrize("first, last, label", [(0.0, 0.06, "Stable"), (0.0, 0.08, "Rising"), (0.08, 0.0, "Falling")])
def test_chart(spark, first, last, label):
    rows = [("2024-01-01 00:05", first, 1), ("2024-01-01 13:05", last, 2)]
    chart = trends.chart_series(series(spark, *rows))
    assert [r.clock for r in chart.orderBy("time").collect()] == ["12:05 AM", "01:05 PM"]
    assert trends.chart_trend(chart).first().trend == label
    assert trends.chart_trend(chart.limit(0)).first().trend == "Stable"


def test_a_label_that_is_no_time_is_kept(one):
    assert one(timebuckets.clock_label("t"), "t string", ("soon",)) == "soon"


def test_rolling_windows_are_whole_across_chunks(spark):
    rng = random.Random(11)
    steps = sorted(rng.sample(range(400_000, 400_300), 180))
    values = {s: rng.uniform(-1, 1) for s in steps}
    parts = spark.createDataFrame(
        [(s * 3600, values[s] / 2, 1) for s in steps] + [(s * 3600, values[s] * 1.5, 1) for s in steps],
        "bucket long, sum_score double, n long",
    )
    rows = trends.rolling(parts, "hour", span=10, chunk=10).orderBy("time").collect()
    assert len(rows) == len(steps)
    for step, row in zip(steps, rows):
        window = [values[s] for s in steps if step - 10 <= s < step]
        assert row["count"] == 2 and row.avg_score == pytest.approx(values[step])
        assert row.rolling_avg == (pytest.approx(sum(window) / len(window)) if window else None)
