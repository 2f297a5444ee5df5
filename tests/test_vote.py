from moodstream.operators import vote

PREDICTION = "struct<label:string, confidence:double>"
SCHEMA = f"text string, bert {PREDICTION}, lstm {PREDICTION}, rf {PREDICTION}"


def voted(spark, row, **options):
    frame = spark.createDataFrame([row], SCHEMA)
    return vote.vote(frame, **options).select("vote.*").first()


def test_missing_model_keeps_its_weight(spark):
    got = voted(spark, ("hi", ("positive", 0.8), None, ("negative", 0.5)))
    assert (got.label, got.score, got.confidence) == ("neutral", 0.3, 0.5)
    assert got.warnings == ["lstm: no prediction"]
    assert got.breakdown["lstm"].asDict() == {"label": "error", "confidence": 0.0, "weight": 0.3}


def test_full_agreement(spark):
    got = voted(spark, ("hi", ("negative", 1.0), ("negative", 1.0), ("negative", 1.0)))
    assert (got.label, got.score, got.confidence, got.warnings, got.error) == ("negative", -1.0, 1.0, [], None)


def test_blank_text(spark):
    got = voted(spark, (" ", ("negative", 1.0), None, None))
    assert (got.label, got.score, got.confidence, got.error) == ("neutral", 0.0, 0.0, "Empty text")


def test_own_weights_need_not_sum_to_one_and_may_name_unknown_models(spark):
    got = voted(spark, ("hi", ("positive", 1.0), None, None), weights={"bert": 3.0, "other": 1.0}, breakdown=False)
    assert (got.score, got.confidence, got.warnings) == (0.75, 0.75, ["other: no prediction"])


def test_unknown_label_counts_as_zero(spark):
    got = voted(spark, ("hi", ("angry", 1.0), ("positive", 1.0), None))
    assert got.score == 0.3
