"""Repeated passages, ranked search and token alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodstream.llm import ranked_search, substring_dedup, token_alignment
from moodstream.llm.queries import tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats_by_hand(texts, width):
    texts = [words_of(t) for t in texts]
    seen = Counter(tuple(t[i : i + width]) for t in texts for i in range(len(t) - width + 1))
    out = []
    for text in texts:
        gone = set()
        for i in range(len(text) - width + 1):
            if seen[tuple(text[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(text), len(gone), " ".join(w for k, w in enumerate(text) if k not in gone)))
    return out


def tangled_texts(seed, width):
    """Few words, runs, periods, shared passages of lengths around a window, edited copies."""
    draw = random.Random(seed)

    def some(n, k):
        return [draw.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n)]

    passages = [some(draw.randint(width - 2, 3 * width), draw.choice([2, 5, 26])) for _ in range(6)]
    passages += [["x"] * (2 * width), ["p", "q", "r"] * width, ["y"] * (width - 1)]
    texts = [None, "", " \t\n", "one", " ".join(["z"] * (width - 1)), "  ".join(["z"] * width)]
    for _ in range(40):
        text = []
        for _ in range(draw.randint(1, 4)):
            text += some(draw.randint(0, 2 * width), draw.choice([1, 2, 26]))
            text += draw.choice(passages)[draw.choice([0, 0, 1, 3]) :]
        texts.append(draw.choice([" ", "\n", "\t "]).join(text))
    edited = texts[-1].split()
    edited[len(edited) // 2 : len(edited) // 2 + 1] = ["new"]
    return texts + [" ".join(edited), texts[-1], texts[-2], texts[-2], "été " * 3 + texts[-3]]


@pytest.mark.parametrize("seed, width", [(1, 35), (3, 8), (4, 70), (5, 2)])
def test_repeated_windows_are_those_found_by_hand(spark, seed, width):
    texts = tangled_texts(seed, width)
    frame = spark.createDataFrame([(k, t, "who") for k, t in enumerate(texts)], "doc_id long, text string, who string")
    got = substring_dedup.without_repeats(frame.repartition(3), width=width).orderBy("doc_id").collect()
    assert [tuple(row)[1:] for row in got] == repeats_by_hand(texts, width)


def test_pieces_of_a_long_text_share_windows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 50)
    texts = tangled_texts(6, 20)
    names = [[w.encode() for w in words_of(t)] for t in texts]
    starts = []
    for got, owner, word in substring_dedup._pieces(names, 20):
        at, key, _ = substring_dedup.anchors(got, owner, 20)
        starts += [(int(owner[k]), int(word[k]), int(a)) for k, a in zip(at, key)]
    whole = [
        (k, int(s), int(a)) for k, text in enumerate(names) if len(text) >= 20
        for s, a in zip(*substring_dedup.anchors(substring_dedup.word_names(text), np.zeros(len(text), int), 20)[:2])
    ]
    assert sorted(starts) == whole


def test_anchors_are_few_and_long(spark):
    draw = random.Random(9)
    text = [draw.choice(["w%d" % k for k in range(5000)]).encode() for _ in range(20_000)]
    start, key, at = substring_dedup.anchors(substring_dedup.word_names(text), np.zeros(len(text), int))
    assert len(np.unique(at)) < 0.15 * len(start)
    assert ((at >= start) & (at < start + 35)).all()


def test_repeated_rows_null_ids_and_digests(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(None, text), (None, text), (1, "a b"), (1, text + " end"), (1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.without_repeats(frame, form="sha256").collect()
    empty, pair = (hashlib.sha256(x).hexdigest() for x in (b"", b"a b"))
    end = hashlib.sha256(b"end").hexdigest()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(None, 50, 50, empty), (None, 50, 50, empty), (1, 2, 0, pair), (1, 51, 50, end), (1, 0, 0, empty)], key=repr
    )
    assert substring_dedup.without_repeats(frame.limit(0)).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def search_by_hand(documents, items, k):
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in documents]
    some = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(term for _, c in counted for term in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counted:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * some) // max(1, total)
            score = 0
            for term in TERM.findall((text or "").translate(LOWER)):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * some + 2) / (2 * df[term] + 1)))
                    score += w * ((1_000_000_000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        found.sort(key=lambda x: x[:3])
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(found[:k])]
    return sorted(out, key=repr)


def searched(seed):
    draw = random.Random(seed)
    vocabulary = ["the", "The", "a", "été", "ÉTÉ", "naïve", "x1", "1x", "foo", "foobar", "bar", "日本", "q"] + [f"w{k}" for k in range(60)]
    marks = [" ", "  ", "-", "_", ",", "\n", "\x00", "(", "'", "\x7f", "a "]

    def text(n):
        return "".join(draw.choice(vocabulary) + draw.choice(marks) for _ in range(n))

    documents = [(k, text(draw.randint(0, 60))) for k in range(150)]
    documents += [(200, None), (201, ""), (202, "-- __"), (None, text(30)), (7, documents[7][1]), (8, text(5))]
    items = [(k, text(draw.randint(1, 12))) for k in range(20)] + [(50, None), (51, ""), (52, "nowhere"), (3, "the foo the")]
    return documents, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_search_is_the_one_by_hand(spark, block_bytes):
    documents, items = searched(1)
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumn("n", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1))
    got = ranked_search.search(docs.repartition(4), asked, k=5, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == search_by_hand(documents, items, 5)


def test_search_in_small_steps_and_without_rows(spark, monkeypatch):
    documents, items = searched(2)
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    for frames in ((docs.limit(0), asked), (docs, asked.limit(0))):
        assert ranked_search.search(*frames).count() == 0
    terms = ranked_search.Terms([0, 1], ["the foo", "bar"])
    best = ranked_search.Best(2, 3)
    rows = np.array([[5, 0], [5, 9], [7, 9], [5, 9], [1, 9]])
    for k in range(len(rows)):
        best.add(rows[k : k + 1], np.array([k == 1]), np.array([10 - k]))
    assert sorted(zip(best.item.tolist(), best.score.tolist(), best.id.tolist())) == [
        (0, 5, 7), (0, 5, 10), (0, 7, 8), (1, 9, 6), (1, 9, 7), (1, 9, 8)]
    assert terms.terms == ["bar", "foo", "the"]


def groups_by_hand(ids, sizes):
    """Cut where tokens of both end together."""
    ends = [list(np.cumsum([sizes[side][k] for k in ids[side]])) for side in (0, 1)]
    both = sorted(set(ends[0]) & set(ends[1]))
    groups, low = [], 0
    for high in both:
        groups.append(tuple([i for i, e in zip(ids[s], ends[s]) if low < e <= high] for s in (0, 1)))
        low = high
    linked = [
        (ids[0][i], ids[1][j]) for i, e in enumerate(ends[0]) for j, f in enumerate(ends[1])
        if e - sizes[0][ids[0][i]] < f and f - sizes[1][ids[1][j]] < e
    ]
    return groups, linked


TEXTS = [
    "Hello world", "hello  world\n\n tabs\t", "naïve café déjà-vu 日本語 emoji 😀👩‍👩‍👧", None, "", " ", "\n", "x" * 300,
    "<s> </s> <|endoftext|> <0x41> <unk>", "▁ already", "á combined ﻿ bom", "\x00\x01 control", "1234567890" * 5, "Hello world",
]


def test_alignment_is_the_one_by_hand(spark):
    a, b = token_alignment.tokenizer_of(A), token_alignment.tokenizer_of(B)
    rows = [(k, t, "z") for k, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, pairs string").repartition(3)
    got = {row["doc_id"]: row for row in token_alignment.align(frame, A, B).collect()}
    sizes = [[len(x) for x in t.bytes] for t in (a, b)]
    hand, counts = {}, Counter()
    for k, text in enumerate(TEXTS):
        ids = token_alignment.tokens_of(text, a, b)
        hand[k] = (ids, *groups_by_hand(ids, sizes))
        counts.update(set(hand[k][2]))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    for k, (ids, groups, linked) in hand.items():
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert got[k].asDict() == {
            "doc_id": k, "n_a": len(ids[0]), "n_b": len(ids[1]), "n_groups": len(groups), "n_links": len(linked),
            "n_best": sum(counts[p] == most[p[0]] for p in linked), "count_sum": sum(counts[p] for p in linked),
            "groups_sha256": hashlib.sha256(text.encode()).hexdigest() if ids[0] else "",
        }
    assert sum(bool(ids[0]) for ids, _, _ in hand.values()) >= 9
    assert got[9]["n_a"] == 0  # the mark for a space is read as one: the bytes differ


def test_tokens_give_back_their_bytes():
    a, b = token_alignment.tokenizer_of(A), token_alignment.tokenizer_of(B)
    text = "The <s> and <|endoftext|> 日本"
    for tokenizer in (a, b):
        ids = tokenizer.encode([text])[0]
        assert b"".join(tokenizer.bytes[k] for k in ids) == (" " + text).encode()
        assert 50256 not in ids if tokenizer is a else not {1, 2} & set(ids)


def test_both_ways_of_merging_give_the_same_ids():
    a = token_alignment.tokenizer_of(A)
    assert a.fast is not None
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}a 1{c}1 !{c}! {c}{c}  {c}  '{c}\n{c}\n\n{c}" for c in every]
    texts += ["we'll they've I'd", "x" * 5000, " " * 9000 + "a", "tab\t\tend \n", "日本語 " * 50]
    assert [a._fast(t) for t in texts] == [a._slow(t) for t in texts]
    assert a.encode([" " * 20_000]) == [a._slow(" " * 20_001)]


def test_counts_in_blocks_add_up(spark):
    draw = random.Random(4)
    words = "alignment tokens überlappen groups 12 naïve of the".split()
    rows = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 30)))) for k in range(40)]
    frame = spark.createDataFrame(rows, "id long, text string")
    done = token_alignment.aligned(frame, A, B)
    base = len(token_alignment.tokenizer_of(B).bytes)
    counts = token_alignment.pair_counts(done, base)
    one, many = (
        sorted(map(tuple, token_alignment.with_counts(done, counts, base, n).collect())) for n in (1 << 20, 5)
    )
    assert one == many and sum(row[-1] for row in one) > 0


def test_pointer_jumping_over_long_chains():
    end_a = np.append(np.arange(1, 2000, 2), 2000)  # no common end before the last
    end_b = np.arange(2, 2001, 2)
    in_a, in_b = token_alignment.group_labels(end_a, end_b)
    assert set(in_a) == set(in_b) == {0}
