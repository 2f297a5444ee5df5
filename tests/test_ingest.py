import json
from pathlib import Path

from pyspark.sql import functions as F

from moodstream import session
from moodstream.operators import ingest


def event(rkey, langs=("en",), text="hello", kind="commit", operation="create", **more):
    record = {"text": text, "createdAt": "2024-01-01T00:00:00Z"}
    if langs != "absent":
        record["langs"] = None if langs is None else list(langs)
    body = {"kind": kind, "did": "d1", "time_us": 1_500_000,
            "commit": {"operation": operation, "rkey": rkey, "record": record}}
    body.update(more)
    return json.dumps(body)


def test_filters_and_flattening(spark):
    lines = [
        event("keep"),
        event("two", langs=["en", "fr"]),
        event("region", langs=["en-US"]),
        event("null", langs=None),
        event("none", langs=[]),
        event("absent", langs="absent"),
        event("deleted", operation="delete"),
        event("identity", kind="identity"),
        event("empty", text=""),
        event("spaces", text="   "),
        '{"kind": "commit", "commit": ',
    ]
    decoded = ingest.decode_events(spark.createDataFrame([(line,) for line in lines], "value string"))
    assert ingest.corrupt_lines(decoded).count() == 1
    posts = ingest.new_posts(ingest.good_events(decoded))
    assert {r.id for r in posts.collect()} == {"keep", "two", "spaces"}
    row = posts.where("id = 'keep'").first()
    assert row.asDict() == {
        "id": "keep", "did": "d1", "source": "bluesky", "timestamp": 1.5, "text": "hello",
        "created_at": "2024-01-01T00:00:00Z",
    }
    anyone = ingest.new_posts(ingest.good_events(decoded), language=None)
    assert anyone.count() == 7


def test_missing_time_is_zero_and_missing_id_is_quarantined(spark):
    lines = [event(None, time_us=None), event("a")]
    posts = ingest.new_posts(
        ingest.good_events(ingest.decode_events(spark.createDataFrame([(line,) for line in lines], "value string")))
    )
    assert posts.where("id is null").first().timestamp == 0.0
    good, bad = ingest.with_id(posts)
    assert (good.count(), bad.count()) == (1, 1)


def test_samples(spark):
    ids = spark.range(20000).select(F.col("id").cast("string"))
    kept = ingest.hash_sample(ids, 0.1)
    assert 1800 < kept.count() < 2200
    again = ingest.hash_sample(ids.repartition(7), 0.1)
    assert kept.exceptAll(again).isEmpty() and again.exceptAll(kept).isEmpty()
    assert ingest.hash_sample(ids, 1.0).count() == 20000
    assert ingest.hash_sample(ids, 0.0).count() == 0
    assert 1800 < ingest.random_sample(ids, 0.1, seed=7).count() < 2200


def test_bounds(spark):
    frame = spark.createDataFrame([("",), ("x",), ("x" * 5000,), ("x" * 5001,), (None,)], "text string")
    fits, rest = ingest.split_by_bounds(frame)
    assert (fits.count(), rest.count()) == (2, 3)


def test_scratch_tables_are_removed_on_request(spark):
    frame = session.written(spark.range(3), "numbers")
    assert frame.count() == 3 and session.scratch(spark, "a") != session.scratch(spark, "a")
    files = frame.inputFiles()
    session.clear_scratch(spark)
    assert files and not any(Path(name.removeprefix("file://")).exists() for name in files)
