"""SimHash groups and connected components against brute force."""

import random

import pytest
import xxhash

from moodstream.llm import simhash
from moodstream.llm.components import connected_components
from moodstream.llm.queries import QUERIES


def _brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_groups(prints):
    root = {p: p for p in prints}
    for p in prints:
        for q in prints:
            if (p ^ q).bit_count() <= 2 and root[p] != root[q]:
                low, high = sorted((root[p], root[q]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def _unsigned(value):
    return value & ((1 << 64) - 1)


def _signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "one", "One TWO", "a b c d e f g", "É é x \x0b y\rz", "word " * 70_000, "a b c a b c a b c",
])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _brute_print(text)


@pytest.mark.parametrize("bucket", [32, 2])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", bucket)
    rng = random.Random(bucket)
    prints = {0, (1 << 64) - 1}
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3]))))
    frame = spark.createDataFrame([(_signed(p),) for p in prints], "fp long")
    links = [(_unsigned(r.a), _unsigned(r.b)) for r in simhash.close_pairs(frame).collect()]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in links)
    found = {r.node: r.component for r in connected_components(simhash.close_pairs(frame)).collect()}
    expected = _brute_groups(prints)
    groups = {}
    for p in prints:
        groups.setdefault(found.get(_signed(p), _signed(p)), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(
        sorted(p for p in prints if expected[p] == r) for r in set(expected.values())
    )


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (500, 499)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    frame = spark.createDataFrame(edges, "a long, b long")
    got = connected_components(frame).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)
    assert connected_components(frame.limit(0)).count() == 0


def _texts():
    rng = random.Random(5)
    base = " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(400))
    near = base.replace(base.split()[200], "other", 1)
    return [(5, base, "a"), (3, base.upper(), "a"), (9, near, "b"), (4, None, None), (8, "", "c"), (None, base, "d"),
            (11, "quite another text here", None), (11, "quite another text here", None), (11, base, "e"),
            (12, "fully different words stand here", "f")]


def test_near_duplicates(spark):
    frame = spark.createDataFrame(_texts(), "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(frame).collect()
    prints = {r[1]: _brute_print(r[1]) for r in _texts()}
    root = _brute_groups(set(prints.values()))
    least = {}
    for doc_id, text, _ in _texts():
        if doc_id is not None:
            key = root[prints[text]]
            least[key] = min(doc_id, least.get(key, doc_id))
    expected = sorted((str(i), prints[t], least[root[prints[t]]]) for i, t, _ in _texts())
    assert sorted((str(r.doc_id), _unsigned(r.fp), r.component_id) for r in got) == expected
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_keep_one(spark):
    frame = spark.createDataFrame(_texts(), "doc_id long, text string, component_id string")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in kept.collect()) == [
        (3, _texts()[1][1][:5]), (4, ""), (11, "quite"), (12, "fully")
    ]
    assert simhash.keep_one(frame.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {i: _brute_print(t) for i, t in docs.items()}
    root = _brute_groups(set(prints.values()))
    least = {}
    for i in sorted(docs, reverse=True):
        least[root[prints[i]]] = i
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_variants"](spark, folder).collect()}
    assert got == {(i, f"{prints[i]:016x}", least[root[prints[i]]]) for i in docs}
