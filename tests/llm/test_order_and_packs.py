"""Sharding, mixing and packing against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from moodstream.llm import mixing, packing, sharding
from moodstream.llm.queries import QUERIES, tokenizer_file, word_tokenizer

SCHEMA = "doc_id long, text string, source string, size string, place int"
ODD = [(3, "one two  three", "b", "x", 1), (1, None, None, None, 2), (None, "", "a", "y", 3), (7, "é" * 9, "b", "z", 4),
       (3, "one two  three", "b", "x", 1), (8, "word " * 5000, "c", None, 5), (9, "a <|endoftext|> İ b.", "a", "q", 6)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(n):
    p = sharding.Permutation.of(n, "s")
    places = [p.place(x) for x in range(n)]
    assert sorted(places) == list(range(n)) and [p.row(y) for y in places] == list(range(n))
    longest = 0
    for x in range(n):
        y, steps = p.once(x), 0
        while y >= n:
            y, steps = p.once(y), steps + 1
        longest = max(longest, steps)
    assert longest == p.walk()


def test_places_in_columns_are_the_computed_ones(spark):
    for n in (1, 2, 7, 50, 1003):
        p = sharding.Permutation.of(n, "t")
        got = p.place_column(spark.range(n).withColumnRenamed("id", "k"), "k", "y").collect()
        assert [r.y for r in sorted(got)] == [p.place(x) for x in range(n)]


def test_shards_of_odd_rows(spark):
    frame = spark.createDataFrame(ODD, SCHEMA)
    got = sharding.shard_documents(frame, shards=3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ODD
    )
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_documents(frame.repartition(5), shards=3).collect()
    key = lambda r: (str(r.doc_id), r.size, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.shard_documents(frame.limit(0)).count() == 0
    assert [r.shard for r in sharding.shard_documents(frame.limit(1), 24).collect()] == [0]


def _targets(sizes):
    """Budgets by giving out, capping and sharing again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    capped, free = {}, dict(weight)
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        if not over:
            return {**{s: float(c) for s, c in capped.items()}, **share}
        for s in over:
            capped[s] = 3 * sizes[s]
            del free[s]


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 1, None: 70, "é": 5, "d": 0}, {"a": 5}, {None: 7, "x": 7}, {"a": 0, "b": 0},
    {f"s{k}": 3 ** (k % 7) for k in range(40)},
])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    expected = _targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert got == pytest.approx(expected)


def _check_mix(rows, texts):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((i, s, count(t)) for i, t, s in texts)
    sums = Counter()
    for r in rows:
        sums[r.source] += r.size
    targets = _targets(sums)
    taken = Counter()
    for r in rows:
        assert r.source_size == sums[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1.001 for s in sums)
    return targets, sums


def test_mix_of_odd_rows(spark):
    frame = spark.createDataFrame(ODD, SCHEMA)
    first = mixing.mix_documents(frame).collect()
    _check_mix(first, [r[:3] for r in ODD])
    assert sorted(map(str, first)) == sorted(map(str, mixing.mix_documents(frame.repartition(7)).collect()))
    assert mixing.mix_documents(frame.limit(0)).count() == 0


def test_mix_takes_the_smallest_keys(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = mixing.mix(mixing.sized(docs), "doc_id", "mix").collect()
    targets, sums = _check_mix(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    for source, target in targets.items():
        epochs = math.floor(target / sums[source])
        order = sorted((r.key, r.taken - epochs * r.size, r.size) for r in rows if r.source == source and r.size)
        parts = [part for _, part, size in order]
        whole = [part == size for _, part, size in order]
        border = whole.index(False)
        assert not any(parts[border + 1 :])
    query = QUERIES["op9_mix_sources"](spark, folder).collect()
    assert {(r.doc_id, r.taken) for r in query} == {(r.doc_id, r.taken) for r in rows}
    copies = Counter(r.doc_id for r in mixing.resample(docs, "mix").collect())
    assert all(abs(copies[r.doc_id] - r.taken / r.size) <= 0.5 for r in rows if r.size)


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert(points, bits)
        assert sorted(keys) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def _check_packs(rows, ids, length):
    left = {k: 0 for k in ids}
    for r in rows:
        own = ids[r.doc_id, r.text_key]
        part = own[r.start : r.start + r.piece_length]
        assert len(part) == r.piece_length and r.doc_tokens == len(own)
        assert np.frombuffer(r.ids, "<u4").tolist() == part
        left[r.doc_id, r.text_key] += len(part)
    assert all(n % len(ids[k]) == 0 and n for k, n in left.items())
    end = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * length + r.offset == end and r.offset + r.piece_length <= length
        end += r.piece_length
    return end


def test_packs_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    path, tokenizer = word_tokenizer(), Tokenizer.from_file(word_tokenizer())
    texts = ODD + [(20, "it's fine, isn't it?.. naïve Œuvre é a b x.y. Zürich.", "a", "b", 1),
                   (21, "word, word. word; THE the The", "a", "b", 1)]
    frame = spark.createDataFrame([(i, t, str(i)) for i, t, *_ in texts], "doc_id long, text string, text_key string")
    ids = {(i, str(i)): tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in texts}
    rows = packing.pack(frame, path, 2, length=64).collect()
    assert _check_packs(rows, ids, 64) == sum(len(ids[i, str(i)]) for i, *_ in texts)
    assert packing.pack(frame.limit(0), path, 2).count() == 0


def test_packs_query(spark):
    folder = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(word_tokenizer())
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    ids = {r.doc_id: np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [2], "<u4") for r in docs}
    rows = QUERIES["op6_hilbert_packs"](spark, folder).collect()
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    full = Counter()
    for r in rows:
        full[r.sequence_id] += r.length
    assert sorted(full) == list(range(len(full))) and sum(n < 4096 for n in full.values()) <= 1
    assert sum(full.values()) == sum(map(len, ids.values()))


def test_a_tokenizer_that_keeps_case_and_spaces():
    """One whose words depend on the space before them encodes texts as a whole."""
    path = tokenizer_file("byte_bpe_50k.json")
    whole, ids = Tokenizer.from_file(path), packing.WordIds(path)
    assert not ids.by_word and packing.WordIds(word_tokenizer()).by_word
    for text in ("Hello World again", "  two  spaces\n", "caf\xe9", "", None):
        expected = whole.encode(text, add_special_tokens=False).ids if text else []
        assert ids.text(text) == packing._packed(expected)
