import re
import string

import pytest
from pyspark.sql import functions as F

from moodstream.functions import text

# The described normalisation, step by step in plain Python.
URLS = re.compile(r"http[s]?://[!a-z$-_]+")


def expected(raw, strict=False):
    said = URLS.sub("", raw or "")
    said = re.sub(r"@\w+", "", said)
    said = re.sub(r"#(\w+)", "" if strict else r"\1", said)
    if strict:
        said = re.sub(r"\d+", "", said)
        said = "".join(c for c in said if c not in string.punctuation)
    return " ".join(said.lower().split())


TEXTS = [
    "Look https://a.example/x?y=1#Top ~ done",
    "HTTP://not.matched http://ok.example/é rest",
    "@José hi @bob_1, ##tag #Été2024 #",
    "tabs\t\tand no-break wide\x1cfile\x85next",
    "  12 apples & 3,5 pears!  ",
    "a" * 300 + " " + "b",
    "",
    None,
]


@pytest.mark.parametrize("strict", [False, True])
def test_clean_matches_the_described_steps(spark, strict):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    flags = dict(remove_hashtags=True, remove_numbers=True, remove_punctuation=True) if strict else {}
    got = [r.c for r in frame.select(text.clean_text("text", **flags).alias("c")).collect()]
    assert got == [expected(t, strict) for t in TEXTS]


def test_every_space_character_collapses(spark):
    codes = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    frame = spark.createDataFrame([(c,) for c in codes], "c string")
    cleaned = text.clean_text(F.concat(F.lit("x"), "c", "c", F.lit("x")))
    spaces = {r.c for r in frame.where(cleaned == "x x").collect()}
    assert spaces == {c for c in codes if c.isspace()}


def test_flags_can_keep_everything(one):
    kept = text.clean_text("text", remove_urls=False, remove_mentions=False, lowercase=False)
    assert one(kept, row=("@Bob http://a.b  C",)) == "@Bob http://a.b C"


@pytest.mark.parametrize("raw, blank", [(None, True), ("", True), (" \t \x1f", True), (" x ", False)])
def test_blank(one, raw, blank):
    assert one(text.is_blank("text"), row=(raw,)) is blank


def test_preview_adds_dots_only_when_longer(one):
    assert one(text.preview("text"), row=("x" * 200,)) == "x" * 200
    assert one(text.preview("text"), row=("x" * 201,)) == "x" * 200 + "..."


def test_letters_class_equals_its_short_form(spark):
    codes = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c <= 0xDFFF]
    frame = spark.createDataFrame([(c,) for c in codes], "c string")
    differing = frame.where(
        F.regexp_replace("c", text.NOT_LETTERS, "") != F.regexp_replace("c", r"[^a-zA-Z\s]", "")
    )
    assert differing.count() == 0


def test_tokens_join_letters_across_signs_and_a_url_becomes_one_word(one):
    raw = "Don't stop http://a.b/c Élan"
    assert one(text.tokens("text"), row=(raw,)) == ["dont", "stop", "httpabc", "lan"]
    assert one(text.tokens("text", clean_first=True), row=(raw,)) == ["dont", "stop", "lan"]


def test_ngrams_of_short_lists(spark):
    frame = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    rows = frame.select(text.ngrams("w", 2).alias("two"), text.ngrams("w", 3).alias("three")).collect()
    assert [r.two for r in rows] == [["a b", "b c"], [], []]
    assert [r.three for r in rows] == [["a b c"], [], []]
