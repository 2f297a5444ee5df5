"""Edited copies against the Jaccard similarity of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from moodstream.llm import edited_copies as e


def _set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _similar(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def _brute_groups(texts):
    sets = {i: _set(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    links = []
    for i in texts:
        for j in texts:
            if i < j and _similar(sets[i], sets[j]):
                links.append((i, j))
                if root[i] != root[j]:
                    low, high = sorted((root[i], root[j]))
                    root = {k: low if v == high else v for k, v in root.items()}
    return root, links


def _family(rng, size, edits, words=200):
    base = [rng.choice("bcdfg") + str(rng.randrange(3000)) for _ in range(words)]
    yield " ".join(base)
    for _ in range(size - 1):
        copy = list(base)
        for at in rng.sample(range(0, words, 6), edits):
            copy[at] = "x" + str(rng.randrange(100_000))
        yield " ".join(copy)


def _corpus(seed):
    rng = random.Random(seed)
    texts = [t for size, edits in [(40, 2), (3, 4), (2, 3), (2, 1), (2, 9), (1, 0), (1, 0)] for t in _family(rng, size, edits)]
    chain = texts[-1].split()
    for k in range(4):  # each step is close to the last one, the ends are not
        chain[k * 40 : k * 40 + 18 : 6] = ["y" + str(k)] * 3
        texts.append(" ".join(chain))
    texts += ["One  two", "one TWO\n", "one two three", "a a a a a a", "a a a a a a a"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("large, dense", [(4096, 16), (8, 2), (64, 1)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, large, dense):
    monkeypatch.setattr(e, "LARGE_BUCKET", large)
    monkeypatch.setattr(e, "SMALL_BUCKET", min(large, 8))
    monkeypatch.setattr(e, "DENSE", dense)
    texts = _corpus(large)
    root, links = _brute_groups(texts)
    got = {r.doc_id: r.root for r in e.grouped(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(links) > 500
    assert all(root[i] == root[j] for i in texts for j in texts if got[i] == got[j])  # none joined wrongly
    assert sum(got[i] == got[j] for i, j in links) >= 0.95 * len(links)


def test_each_close_pair_comes_once(spark):
    rng = random.Random(2)
    rows = []
    for key in range(300):
        if key % 3 == 0:
            base = [rng.getrandbits(60), rng.getrandbits(60)]
        flips = rng.sample(range(120), rng.randrange(0, 14))
        near = [base[k] ^ sum(1 << (f % 60) for f in flips if f // 60 == k) for k in (0, 1)]
        rows.append((key, *near))
    pairs, crowd = e.candidates(spark.createDataFrame(rows, "key long, fp0 long, fp1 long"))
    got = [(r.a, r.b) for r in pairs.collect()]
    expected = set()
    for i, *x in rows:
        for j, *y in rows:
            differ = [p ^ q for p, q in zip(x, y)]
            parts = [(d >> 20 * s & 0xFFFFF).bit_count() for d in differ for s in range(3)]
            if i < j and min(parts) <= 1 and sum(parts) <= e.DISTANCE:
                expected.add((i, j))
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 200 and crowd.count() == 0


def test_recall_over_edited_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null")
    rng = random.Random(4)
    rows, pairs = [], []
    for r in docs.orderBy("doc_id").collect():
        words = r.text.split()
        rows.append((r.doc_id, r.text))
        if len(words) >= 100 and len(pairs) < 400:
            copy = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) // rng.choice([50, 60, 80, 200]))):
                copy[at] = "edited" + str(rng.randrange(1000))
            copy = " ".join(copy)
            if _similar(_set(r.text), _set(copy)):
                rows.append((100_000 + r.doc_id, copy))
                pairs.append((r.doc_id, 100_000 + r.doc_id))
    root = {r.doc_id: r.root for r in e.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 300 and sum(root[a] == root[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_keep_one(spark):
    rng = random.Random(8)
    base, near = _family(rng, 2, 2)
    long = " ".join(["word"] * 300_000)
    rows = [(9, near, "r"), (3, base.upper(), "a"), (5, base, "b"), (None, base, "c"), (4, None, None), (8, "", "d"),
            (6, " \n", "d"), (11, "quite another text", "e"), (11, "quite another text", "e"), (11, near, "f"),
            (12, long, "g"), (2, long, "h"), (None, "alone", "i"), (13, "something else", "j")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = e.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:5]) for r in kept.collect()) == [
        (-1, "alone"), (2, "word "), (3, base.upper()[:5]), (4, ""), (11, "quite"), (13, "somet")
    ]
    assert e.keep_one(frame.limit(0)).count() == 0


def _brute_sets(sets):
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and root[i] != root[j] and _similar(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("dense, levels, few", [(16, 4, 64), (1, 4, 64), (1, 2, 3), (0, 3, 5)])
def test_links_within_a_bucket_are_those_of_all_pairs(spark, monkeypatch, dense, levels, few):
    monkeypatch.setattr(e, "DENSE", dense)
    monkeypatch.setattr(e, "LEVELS", levels)
    monkeypatch.setattr(e, "FEW", few)
    rng = random.Random(10 * dense + few)
    fresh = iter(range(10_000, 10**9)).__next__
    sets = [set(), {1, 2}]
    for size in (90, 90, 40):
        base = [fresh() for _ in range(size)]
        for _ in range(60):  # replaced, lost and added; edits partly taken over from an earlier copy
            copy = list(rng.choice(sets[-5:] if rng.random() < 0.4 and len(sets) > 10 else [base]))
            for _ in range(rng.randrange(0, 14)):
                kind = rng.random()
                if kind < 0.7 and copy:
                    copy.pop(rng.randrange(len(copy)))
                if kind > 0.3:
                    copy.append(fresh() if rng.random() < 0.8 else 5000 + rng.randrange(9))
            sets.append(set(copy))
    sets = dict(enumerate(sets))
    want = _brute_sets(sets)
    frame = spark.createDataFrame([(k, list(v)) for k, v in sets.items()], "key long, shingles array<long>")
    buckets = spark.createDataFrame([(k % 2 if k < 90 else 7, k) for k in sets] + [(7, k) for k in range(90)], "sig long, key long")
    got = {r.node: r.component for r in e.crowd_groups(buckets, spark.createDataFrame([], "a long, b long"), frame).collect()}
    assert {k: got.get(k, k) for k in sets} == want and 20 < len(set(want.values())) < len(sets) - 20


def test_compared_pairs_grow_with_the_family_not_its_square(spark, monkeypatch):
    rng = random.Random(3)
    base = list(_family(rng, 1, 0))[0].split()
    texts = []
    for k in range(300):  # a third lies close to the first text, the others too far from it and from each other
        copy = list(base)
        for at in rng.sample(range(0, 200, 6), 1 if k % 3 == 0 else rng.randrange(5, 7)):
            copy[at] = f"x{k}y{at}"
        texts.append(" ".join(copy))
    compared, linked = [], e._linked
    monkeypatch.setattr(e, "_linked", lambda pairs, sets: compared.append(pairs.count()) or linked(pairs, sets))
    rows = list(enumerate(texts))
    got = {r.doc_id: r.root for r in e.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root, _ = _brute_groups(dict(rows))
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in root for j in root)
    assert sum(compared[1:]) <= 2 * len(texts), compared  # of crowded buckets, beyond their middles


def test_buckets_are_put_together_from_segments(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(60), rng.getrandbits(60)]
    rows = [(key, *(part ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for part in base)) for key in range(60)]
    classes = spark.createDataFrame(rows, "key long, fp0 long, fp1 long")
    signed = e._signatures(classes)
    parts = e.segments_of(signed.select("sig").distinct())
    met = parts.join(e.segment_rows(classes, parts), "sig").select("bucket", "key", "fp0", "fp1")
    assert sorted(met.collect()) == sorted(signed.select("sig", "key", "fp0", "fp1").collect())


def test_a_crowded_row_is_taken_once_a_segment(spark, monkeypatch):
    rows = list(enumerate(t for edits in (1, 2) for t in _family(random.Random(edits), 200, edits)))
    taken, groups = [], e.crowd_groups
    monkeypatch.setattr(e, "crowd_groups", lambda crowd, *more: taken.append(crowd.count()) or groups(crowd, *more))
    got = {r.doc_id: r.root for r in e.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root, _ = _brute_groups(dict(rows))
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in root for j in root)
    assert len(rows) < taken[0] <= 2 * e.SEGMENTS * len(rows), taken


def test_a_bucket_over_several_batches_is_named_once(monkeypatch):
    monkeypatch.setattr(e, "LARGE_BUCKET", 40)
    rows = [(sig, key, key % 7, 0) for sig, size in ((3, 100), (4, 100), (5, 2)) for key in range(size)]
    for step in (7, 50, 100, 300):
        slices = [np.array(rows[low : low + step], np.int64).T for low in range(0, len(rows), step)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in s], names=["sig", "key", "fp0", "fp1"]) for s in slices]
        found = [r for b in e._buckets(iter(batches)) for r in b.to_pylist()]
        assert sorted(r["sig"] for r in found if r["sig"] is not None) == [3, 4], step
