import pytest
from pyspark.sql import functions as F

from moodstream.functions import scoring


@pytest.mark.parametrize(
    "polarity, text, label, score",
    [
        (0.1, "x", "neutral", 0.1),
        (-0.1, "x", "neutral", -0.1),
        (0.1001, "x", "positive", 0.1001),
        (-0.1001, "x", "negative", -0.1001),
        (0.9, "", "neutral", 0.0),
        (0.9, None, "neutral", 0.0),
        (None, "x", "neutral", 0.0),
        (0.9, "   ", "positive", 0.9),
    ],
)
def test_polarity_sentiment(one, polarity, text, label, score):
    got = one(scoring.polarity_sentiment("text", "p"), "text string, p double", (text, polarity))
    assert (got.label, got.score) == (label, score)


@pytest.mark.parametrize(
    "text, label, polarity",
    [
        ("fine", "neutral", 0.0),
        ("WHATever", "negative", -0.3),
        ("good good bad", "neutral", 0.0),
        ("good happy bad", "positive", 0.3),
        ("goodbye", "positive", 0.3),
    ],
)
def test_keyword_prediction(one, text, label, polarity):
    got = one(scoring.keyword_prediction("text"), row=(text,))
    assert got.asDict() == {"label": label, "confidence": 0.5, "polarity": polarity, "subjectivity": 0.5}
    scored = one(scoring.keyword_sentiment("text"), row=(text,))
    assert (scored.label, scored.score) == (label, polarity)


@pytest.mark.parametrize("text", [None, "", "   ", " "])
def test_blank_text_has_no_confidence(one, text):
    got = one(scoring.keyword_prediction("text"), row=(text,))
    assert got.asDict() == {"label": "neutral", "confidence": 0.0, "polarity": 0.0, "subjectivity": 0.0}
    scored = one(scoring.keyword_sentiment("text"), row=(text,))
    assert (scored.label, scored.score) == ("neutral", 0.0)


def test_own_word_lists(one):
    got = one(scoring.keyword_prediction("text", ["up"], ["down"]), row=("going UP",))
    assert got.label == "positive"


def test_confidence_is_capped(one):
    got = one(scoring.polarity_prediction("p", "s"), "p double, s double", (-1.0, 1.0))
    assert got.asDict() == {
        "label": "negative", "confidence": 1.0, "polarity": -1.0, "subjectivity": 1.0, "error": None}


@pytest.mark.parametrize("row, error", [
    ((None, 1.0, "x"), "No polarity"), ((0.5, None, "x"), "No polarity"), ((0.9, 1.0, "  "), "Empty text"),
    ((0.9, 1.0, None), "Empty text"),
])
def test_no_confidence_without_a_polarity(one, row, error):
    got = one(scoring.polarity_prediction("p", "s", "t"), "p double, s double, t string", row)
    assert (got.label, got.confidence, got.polarity, got.error) == ("neutral", 0.0, 0.0, error)


@pytest.mark.parametrize(
    "rating, label, confidence, stars",
    [
        ("1 star", "negative", 0.8, 1),
        ("2 stars", "negative", 0.68, 2),
        ("3 stars", "neutral", 0.56, 3),
        ("4 stars", "positive", 0.68, 4),
        (" 5 stars", "positive", 0.8, 5),
        ("stars", "neutral", 0.0, 3),
        ("4stars", "neutral", 0.0, 3),
        ("99999999999 stars", "neutral", 0.0, 3),
        (None, "neutral", 0.0, 3),
    ],
)
def test_star_prediction(one, rating, label, confidence, stars):
    got = one(scoring.star_prediction("r", F.lit(0.8)), "r string", (rating,))
    assert (got.label, got.confidence, got.raw_stars) == (label, confidence, stars)


def test_star_value(one):
    assert [one(scoring.star_value("n"), "n int", (n,)) for n in (1, 3, 5, None)] == [-1.0, 0.0, 1.0, 0.0]


@pytest.mark.parametrize(
    "probabilities, score",
    [({"positive": 0.7, "negative": 0.1}, 0.6), ({"negative": 0.5}, -0.17), ({}, 0.0), (None, 0.0)],
)
def test_probability_value(one, probabilities, score):
    got = one(scoring.probability_value("p"), "p map<string,double>", (probabilities,))
    assert got == pytest.approx(score)


@pytest.mark.parametrize("value, label", [(0.33, "neutral"), (-0.33, "neutral"), (0.34, "positive"), (-0.34, "negative")])
def test_vote_threshold_is_strict(one, value, label):
    assert one(scoring.label_by_threshold("v", scoring.VOTE_THRESHOLD), "v double", (value,)) == label
