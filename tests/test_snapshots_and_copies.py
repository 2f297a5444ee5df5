"""One version of all tables, copies over the whole run, sketches of word counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_state_and_streams import counts, deliver, posts

from moodstream.operators import sketch
from moodstream.plans import serve
from moodstream.sources import events
from moodstream.streaming import copies, jobs, state


class Stopped(Exception):
    pass


@pytest.mark.parametrize("table", ["topic_parts", "post_parts", "label_parts", "manifest"])
def test_run_stopped_between_two_tables(spark, tmp_path, monkeypatch, table):
    root = str(tmp_path)
    state.update_state(posts(spark, range(5)), root, 0)
    write = state.write_parts

    def stopping(parts, at, name, batch_id, **options):
        if name == table:
            raise Stopped
        write(parts, at, name, batch_id, **options)

    monkeypatch.setattr(state, "write_parts", stopping)
    with pytest.raises(Stopped):
        state.update_state(posts(spark, range(5, 12)), root, 1)
    monkeypatch.setattr(state, "write_parts", write)

    def seen(n):
        at = state.snapshot(spark, root)
        assert counts(at.totals())["total"] == n == counts(serve.stats(spark, root))["total"]
        assert at.trends().agg(F.sum("count")).first()[0] == n
        words = at.topics().agg(F.sum("count")).first()[0]
        assert words == at.parts("topic_parts").agg(F.sum("count")).first()[0]
        assert at.latest_posts().count() == at.cold().count() == n
        state.register_views(spark, root)
        assert spark.sql("SELECT total_count FROM sentiment_stats").first()[0] == n
        assert spark.sql("SELECT count(*) FROM posts_recent").first()[0] == n
        return words

    words = seen(5)
    state.update_state(posts(spark, range(5, 12)), root, 1)
    assert seen(12) > words


def test_versions_stay_as_they_were(spark, tmp_path):
    root = str(tmp_path / "run")
    assert state.snapshot(spark, root).version is None
    assert counts(state.snapshot(spark, root).totals())["total"] == 0
    assert state.snapshot(spark, root).cold().count() == 0
    for batch in (0, 1, 3):
        state.update_state(posts(spark, range(batch * 5, batch * 5 + 5)), root, batch)
    assert [counts(state.snapshot(spark, root, v).totals())["total"] for v in (0, 1, 3)] == [5, 10, 15]
    with pytest.raises(ValueError):
        state.snapshot(spark, root, 2)
    state.update_state(posts(spark, range(90)), root, 3)  # a committed batch is left alone
    assert counts(state.totals(spark, root))["total"] == 15
    assert [(r.batch_id, r.posts) for r in state.committed(spark, root).orderBy("batch_id").collect()] == [(0, 5), (1, 5), (3, 5)]


def test_compaction_carries_quarantine_and_sketches(spark, tmp_path):
    inbox, root, into, check = (str(tmp_path / n) for n in ("in", "state", "into", "check"))
    for k in range(3):
        deliver(posts(spark, range(4 * k, 4 * k + 4)), inbox)
        (tmp_path / "in" / f"bad{k}.json").write_text('{"id": "9"}\n{broken\n')
        jobs.keep_state(events.parsed_post_stream(spark, inbox), root, check, once=True, sketch=4).awaitTermination()
    state.compact(spark, root, into, up_to=1)
    old, new = ({(r.reason, r.line) for r in state.quarantine(spark, at).collect()} for at in (root, into))
    assert old == new and state.quarantine(spark, into).count() == 6
    assert sorted({r.batch_id for r in state.quarantine(spark, into).collect()}) == [1, 2]
    assert sorted(map(tuple, state.topic_bounds(spark, into, 4).collect())) == sorted(
        map(tuple, state.topic_bounds(spark, root, 4).collect()))
    assert counts(state.totals(spark, into))["total"] == 12
    assert [(r.batch_id, r.posts) for r in state.committed(spark, into).orderBy("batch_id").collect()] == [(1, 8), (2, 4)]


def test_words_of_a_batch_are_written_by_more_than_one_task(spark, tmp_path):
    frame = posts(spark, range(50)).withColumn("text", F.concat(F.lit("wordy"), F.translate("id", "0123456789", "abcdefghij")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        state.update_state(frame, str(tmp_path), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {name: len(list((tmp_path / name / "batch_id=0").glob("part-*"))) for name in ("topic_parts", "post_parts", "label_parts")}
    assert files["topic_parts"] > 1 and files["post_parts"] == files["label_parts"] == 1


@pytest.mark.parametrize("bits", [16, copies.BITS])
def test_first_copies_over_many_batches(spark, tmp_path, bits):
    draw, root = random.Random(bits), str(tmp_path / "seen")
    seen, kept = set(), []
    for batch in range(4):
        rows = []
        for _ in range(120):
            key = (draw.choice(["u1", "u2", None]), draw.choice([None, *map(str, range(150))]))
            rows.append((key[1], key[0], "src", 86400.0 * draw.randrange(6), f"t{draw.randrange(3)}", "at"))
        frame = spark.createDataFrame(rows, posts(spark, []).schema)
        got = [tuple(r) for r in copies.first_copies(frame, root, batch, bits=bits).collect()]
        if batch == 2:  # a repeated batch gives the same again
            assert sorted(got, key=repr) == sorted(map(tuple, copies.first_copies(frame, root, batch, bits=bits).collect()), key=repr)
        least = {}
        for row in rows:
            key = (row[1], row[0])
            if row[0] is not None and key not in seen and (key not in least or row[3:6] < least[key][3:6]):
                least[key] = row
        expected = [*least.values(), *(r for r in rows if r[0] is None)]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
        seen |= set(least)
        kept += least
    full = {r.date: r.bits_set for r in copies.seen_days(spark, root).collect()}
    assert len(full) == 6 and sum(full.values()) <= len(kept)


def test_copies_days_apart_in_a_stream(spark, tmp_path):
    inbox, root, out, check = (str(tmp_path / n) for n in ("in", "seen", "out", "check"))
    for minute, numbers in ((0, range(8)), (5000, range(4, 12)), (0, range(12)), (9000, [])):
        deliver(posts(spark, numbers, minute), inbox)
        copies.keep_first_copies(events.post_stream(spark, inbox), root, out, check, once=True).awaitTermination()
    assert sorted(int(r.id) for r in spark.read.parquet(out).collect()) == list(range(12))


def test_only_days_that_may_hold_a_post_are_read(spark, tmp_path):
    root = str(tmp_path)
    for day in range(5):
        copies.first_copies(posts(spark, range(10 * day, 10 * day + 10), minute=1440 * day), root, day)
    for day in (0, 1, 3, 4):  # the ids of these days can't be read any more
        for file in (tmp_path / "seen" / f"date=1970-01-0{day + 1}").rglob("part-*.parquet"):
            file.write_bytes(b"broken")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    got = copies.first_copies(posts(spark, [21, 25, 77], minute=1440 * 9), root, 9)
    assert [r.id for r in got.collect()] == ["77"]


@pytest.mark.parametrize("seed, k", [(1, 5), (2, 40), (3, 1000)])
def test_sketches_bound_every_count(spark, seed, k):
    draw = random.Random(seed)
    batches = [Counter(f"w{min(int(draw.expovariate(0.05)), 400)}" for _ in range(2000)) for _ in range(5)]
    true = sum(batches, Counter())
    rows = [
        sketch.summary(spark.createDataFrame(list(c.items()), "word string, count long"), k, "word").withColumn("part", F.lit(n))
        for n, c in enumerate(batches)
    ]
    parts = rows[0]
    for more in rows[1:]:
        parts = parts.unionByName(more)
    found = {r.word: r for r in sketch.bounds(sketch.merged(parts, k, "word", part="part")).collect()}
    total = sum(true.values())
    assert len(found) <= k and all(r.low <= true[w] <= r.high and r.total == total for w, r in found.items())
    assert all(r.high - r.low <= total / (k + 1) for r in found.values())
    assert {w for w, n in true.items() if n > total / (k + 1)} <= set(found)
    if k >= len(true):
        assert {w: (r.low, r.high) for w, r in found.items()} == {w: (n, n) for w, n in true.items()}


def test_sketch_of_nothing_and_of_equal_counts(spark):
    none = spark.createDataFrame([], "word string, count long")
    assert sketch.bounds(sketch.summary(none, 3, "word")).count() == 0
    equal = sketch.summary(spark.createDataFrame([(w, 2) for w in "abcd"], "word string, count long"), 2, "word")
    assert [tuple(r) for r in equal.collect()] == [(None, 0, 2, 8)]  # all cut away: error and total stay
    again = sketch.merged(equal.withColumn("p", F.lit(0)), 2, "word", part="p")
    assert [tuple(r) for r in again.collect()] == [(None, 0, 2, 8)]


def test_texts_of_old_posts_stay_where_they_are(spark, tmp_path, monkeypatch):
    held, write = [], copies.written
    monkeypatch.setattr(copies, "written", lambda frame, label: held.append((label, "text" in frame.columns)) or write(frame, label))
    root = str(tmp_path)
    for number, ids in enumerate((range(20), range(10, 30))):
        got = copies.first_copies(posts(spark, ids, minute=5000 * number), root, number)
        assert sorted(int(r.id) for r in got.collect()) == list(ids if number == 0 else range(20, 30))
    assert {label for label, text in held if text} == {"fresh"}
