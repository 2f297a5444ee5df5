"""Label model, change points, negation, late posts and long texts against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_state_and_streams import deliver, posts

from moodstream.functions.scoring import LABELS
from moodstream.operators import changes, labellers, models, polarity
from moodstream.sources import events
from moodstream.streaming import late


def votes_of(seed, n=300):
    draw = random.Random(seed)
    rows, truth = [], {}
    for item in range(n):
        truth[item] = draw.choice(LABELS)
        for labeller, skill in (("good", 0.9), ("fair", 0.7), ("coin", 0.34), ("wrong", 0.05)):
            if draw.random() < 0.8:
                others = [label for label in LABELS if label != truth[item]]
                rows.append((item, labeller, truth[item] if draw.random() < skill else draw.choice(others)))
    return rows, truth


def em_by_hand(rows, rounds, smooth=1.0):
    items = {}
    for item, labeller, label in set(rows):
        items.setdefault(item, []).append((labeller, label))
    p = {i: {c: sum(v == c for _, v in votes) / len(votes) for c in LABELS} for i, votes in items.items()}
    for _ in range(rounds):
        share = {c: (sum(q[c] for q in p.values()) + smooth) / (len(p) + smooth * 3) for c in LABELS}
        cell = {}
        for i, votes in items.items():
            for j, said in votes:
                for c in LABELS:
                    cell[j, said, c] = cell.get((j, said, c), 0.0) + p[i][c]
        names = {j for j, _, _ in cell}
        conf = {(j, s, c): (cell.get((j, s, c), 0) + smooth) / (sum(cell.get((j, x, c), 0) for x in LABELS) + smooth * 3)
                for j in names for s in LABELS for c in LABELS}
        for i, votes in items.items():
            x = {c: math.log(share[c]) + sum(math.log(conf[j, s, c]) for j, s in votes) for c in LABELS}
            low = max(x.values())
            total = sum(math.exp(v - low) for v in x.values())
            p[i] = {c: math.exp(x[c] - low) / total for c in LABELS}
    return p


@pytest.mark.parametrize("rounds", [1, 8])
def test_label_model_is_the_one_by_hand(spark, rounds):
    rows, truth = votes_of(rounds)
    odd = [(1, "good", "unknown"), (2, None, "positive"), (3, "good", None), (9999, "good", None)]
    frame = spark.createDataFrame(rows + rows[:50] + odd, "item long, labeller string, label string")
    items = labellers.gathered(frame, "item")
    found = {r["item"]: r for r in labellers.combined(items, labellers.fit(items, rounds=rounds)).collect()}
    hand = em_by_hand(rows, rounds)
    assert set(found) == set(hand)
    for item, p in hand.items():
        assert found[item].probabilities == pytest.approx(p)
        assert found[item].confidence == pytest.approx(max(p.values()))
    if rounds == 8:
        right = sum(found[i].label == truth[i] for i in found) / len(found)
        said = {}
        for item, _, label in rows:
            said.setdefault(item, []).append(label)
        most = sum(max(LABELS, key=said[i].count) == truth[i] for i in said) / len(said)
        assert right > most  # plain majorities do worse


def test_label_model_of_nothing(spark):
    items = labellers.gathered(spark.createDataFrame([], "item long, labeller string, label string"), "item")
    model = labellers.fit(items, rounds=2)
    assert model.shares == pytest.approx((1 / 3,) * 3) and labellers.combined(items, model).count() == 0


@pytest.mark.parametrize("chunk", [3, 24, 10_000])
def test_sums_and_alarms_are_those_of_a_loop(spark, chunk):
    draw = random.Random(chunk)
    level, rows = 0.0, []
    for hour in range(200):
        if hour in (60, 140):
            level = 0.4 if hour == 60 else -0.5
        if draw.random() < 0.85:
            n = draw.randint(1, 4)
            rows += [(3600 * hour, (level + draw.gauss(0, 0.2)) * n, n), (3600 * hour, None, 0)]
    rows += [(None, 1.0, 2)]
    frame = spark.createDataFrame(rows, "bucket long, sum_score double, n long")
    got = changes.change_points(frame, "hour", target=0.0, slack=0.1, limit=1.0, chunk=chunk).orderBy("time").collect()
    sums, zero, expected = {"up": 0.0, "down": 0.0}, {"up": None, "down": None}, []
    for bucket, total, n in rows:
        if not n or bucket is None:
            continue
        alarm = since = None
        for name, sign in (("up", 1), ("down", -1)):
            before, sums[name] = sums[name], max(0.0, sums[name] + sign * total / n - 0.1)
            if sums[name] == 0:
                zero[name] = bucket
            if sums[name] > 1.0 >= before and alarm is None:
                alarm, since = name, zero[name]
        expected.append((total / n, sums["up"], sums["down"], alarm, since))
    assert len(got) == len(expected)
    clock = {r.bucket: r.t for r in frame.select("bucket", changes.bucket_label("bucket").alias("t")).collect()}
    for row, (mean, up, down, alarm, since) in zip(got, expected):
        assert (row.avg_score, row.upper, row.lower) == pytest.approx((mean, up, down), abs=1e-9)
        assert (row.alarm, row.since) == (alarm, clock.get(since) if since is not None else None)
    assert [r.alarm for r in got if r.alarm][:1] == ["up"] and "down" in [r.alarm for r in got]


def test_changes_without_given_limits_and_without_posts(spark):
    steady = spark.createDataFrame([(3600 * h, 0.5, 1) for h in range(5)], "bucket long, sum_score double, n long")
    assert {(r.upper, r.lower, r.alarm) for r in changes.change_points(steady).collect()} == {(0.0, 0.0, None)}
    assert changes.change_points(steady.limit(0)).count() == 0


def ruled_by_hand(text, lexicon, negations, boosts, reach):
    total, n, negated, open_, boost = 0.0, 0, 0, -1, {}
    for pos, word in enumerate((text or "").lower().split()):
        if word in negations:
            open_ = pos + reach
        elif word in boosts:
            boost = {pos + 1: boosts[word]}
        elif word in lexicon:
            flip = open_ >= pos
            value = lexicon[word] * boost.get(pos, 1.0) * (-0.5 if flip else 1.0)
            total, n, negated, open_ = total + max(-1.0, min(1.0, value)), n + 1, negated + flip, -1
    return (total / n if n else 0.0), n, negated


def test_polarity_rules_are_those_of_a_loop(spark):
    draw = random.Random(3)
    lexicon = {"good": 0.7, "bad": -0.6, "fine": 0.3, "not": 0.9}
    negations, boosts = ["not", "never"], {"very": 1.5, "slightly": 0.5, "never": 2.0}
    vocabulary = [*lexicon, *negations, *boosts, "a", "b", "c"]
    texts = ["not very good", "never a b good", "not a b c good", "very very good", "not bad bad", "", None, "plain"]
    texts += [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 25))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = spark.createDataFrame(list(lexicon.items()), "word string, polarity double")
    rules = polarity.rule_frame(spark, negations, boosts)
    got = {r.id: (r.polarity, r.hits, r.negated) for r in polarity.ruled_scores(frame, words, rules).collect()}
    lexicon.pop("not")
    boosts.pop("never")
    for k, text in enumerate(texts):
        expected = ruled_by_hand(text, lexicon, negations, boosts, polarity.REACH)
        assert got[k] == pytest.approx(expected)
    assert got[0] == (pytest.approx(0.7 * 1.5 * -0.5), 1, 1) and got[1][2] == 1 and got[2][2] == 0
    assert polarity.ruled_scores(frame, words, polarity.rule_frame(spark)).count() == len(texts)


def test_on_time_and_late_are_all(spark, tmp_path):
    inbox, root, check = (str(tmp_path / n) for n in ("in", "split", "check"))

    def run():
        late.keep_late(events.post_stream(spark, inbox), root, check, delay=300.0, once=True).awaitTermination()

    deliver(posts(spark, range(10), minute=100), inbox)  # nothing is late before a watermark
    run()
    deliver(posts(spark, range(10, 14), minute=98), inbox)  # within the delay
    deliver(posts(spark, range(14, 18), minute=80), inbox)  # behind it
    run()
    deliver(posts(spark, range(18, 20), minute=80), inbox)
    run()
    behind = spark.read.parquet(f"{root}/late")
    on_time = spark.read.parquet(f"{root}/on_time")
    assert sorted(int(r.id) for r in behind.collect()) == [*range(14, 20)]
    assert sorted(int(r.id) for r in on_time.collect()) == [*range(14)]
    assert {round(r.seconds_late) for r in behind.where("id = '14'").collect()} == {100 * 60 + 9 - 300 - 80 * 60 - 14}
    shares = {r.batch_id: (r.on_time, r.late) for r in late.late_share(spark, root).collect()}
    assert shares == {0: (10, 0), 1: (4, 4), 2: (0, 2)}


def test_a_repeated_batch_is_split_alike_and_empty_batches_pass(spark, tmp_path):
    root = str(tmp_path)
    late.split_late(posts(spark, [1], minute=100), root, 0, delay=60.0)
    for _ in range(2):
        on_time, behind = late.split_late(posts(spark, [2], minute=200).union(posts(spark, [3], minute=50)), root, 1, delay=60.0)
        assert [r.id for r in on_time.collect()] == ["2"] and [r.id for r in behind.collect()] == ["3"]
    on_time, behind = late.split_late(posts(spark, []), root, 2, delay=60.0)
    assert on_time.count() == behind.count() == 0
    no_time = posts(spark, [5]).withColumn("timestamp", F.lit(None).cast("double"))
    assert late.split_late(no_time, root, 3, delay=60.0)[0].count() == 1


@pytest.mark.parametrize("size, step", [(5, 3), (4, 4), (100, 50)])
def test_windows_cover_every_word(spark, size, step):
    def load():
        return lambda texts: [float(len(t.split())) + (100.0 if "end" in t.split() else 0.0) for t in texts]

    texts = [" ".join(["w"] * k + ["end"]) for k in range(30)] + [None, "", " \n\t"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in models.score_long_texts(frame, load, size=size, step=step, batch_size=3).collect()}
    for k, text in enumerate(texts):
        words = (text or "").split()
        starts = [0] if words else []
        while words and starts[-1] + size < len(words):
            starts.append(starts[-1] + step)
        parts = [words[s : s + size] for s in starts]
        assert got[k].windows == len(parts)
        if not parts:
            assert got[k].score is None
            continue
        rated = [len(p) + (100 if "end" in p else 0) for p in parts]
        assert got[k].score == pytest.approx(sum(r * len(p) for r, p in zip(rated, parts)) / sum(map(len, parts)))
        assert got[k].highest == max(rated) >= 100  # the last word is seen
    with pytest.raises(ValueError):
        models.score_long_texts(frame, load, size=5, step=6)
