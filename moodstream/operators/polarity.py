"""Polarity of a text with negation and intensifiers: rules in a table, a small state machine in each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodstream.functions.text import tokens
from moodstream.operators.lookup import join_word_list

#: A negated word counts this much of its polarity.
FLIP = -0.5
#: A negation reaches this many tokens ahead, up to the first word of the lexicon.
REACH = 3

# Rules of our own: what turns the next word around, and what strengthens or weakens it.
NEGATIONS = "not no never none nobody nothing neither nor nowhere without cannot cant dont doesnt didnt isnt wasnt wont".split()
INTENSIFIERS = {
    "very": 1.3, "really": 1.3, "extremely": 1.6, "absolutely": 1.5, "so": 1.2, "too": 1.2, "totally": 1.4,
    "quite": 1.1, "rather": 0.9, "somewhat": 0.7, "slightly": 0.5, "barely": 0.4, "hardly": 0.4,
}


def rule_frame(spark, negations: list[str] | None = None, intensifiers: dict[str, float] | None = None) -> DataFrame:
    """``(word, kind, weight)`` of the rules."""
    negations = NEGATIONS if negations is None else negations
    intensifiers = INTENSIFIERS if intensifiers is None else intensifiers
    rows = [(word, "negation", FLIP) for word in negations]
    rows += [(word, "intensifier", weight) for word, weight in intensifiers.items() if word not in negations]
    return spark.createDataFrame(rows, "word string, kind string, weight double")


def ruled_scores(
    posts: DataFrame, lexicon: DataFrame, rules: DataFrame, *, key: str = "id", text: str = "text", reach: int = REACH
) -> DataFrame:
    """``(key, polarity, hits, negated)`` of every key: mean polarity of its lexicon words, within -1 and 1.

    A lexicon word is multiplied by the intensifier directly before it, and turned around by a
    negation among the ``reach`` tokens before it if no lexicon word stands between.  A word that
    is a rule is not read as a lexicon word.  Texts without a hit have polarity 0.  ``lexicon`` is
    ``(word, polarity, …)`` and ``rules`` ``(word, kind, weight)``, one row per word each.  Only hits
    are gathered per key, so the shuffle carries no text.
    """
    listed = lexicon.join(rules, "word", "left_anti").select("word", F.lit("word").alias("kind"), F.col("polarity").alias("weight"))
    table = listed.unionByName(rules.select("word", "kind", "weight"))
    words = posts.select(key, F.posexplode(tokens(text)).alias("pos", "word"))
    found = join_word_list(words, table, "inner").where(F.col("weight").isNotNull())
    hits = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "weight"))).alias("_hits"))
    read = hits.select(key, _read("_hits", reach).alias("read")).select(key, "read.*")
    return posts.select(key).join(read, key, "left").select(
        key, F.coalesce("polarity", F.lit(0.0)).alias("polarity"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"),
        F.coalesce("negated", F.lit(0).cast("long")).alias("negated"),
    )


def _read(hits: str, reach: int) -> Column:
    def state(total, n, negated, open_, flip, boost, boosted) -> Column:
        return F.struct(
            total.alias("total"), n.alias("n"), negated.alias("negated"), open_.alias("open"), flip.alias("flip"),
            boost.alias("boost"), boosted.alias("boosted"),
        )

    none, zero, one = F.lit(-1), F.lit(0).cast("long"), F.lit(1.0)
    begin = state(F.lit(0.0), zero, zero, none, one, one, none)

    def step(s: Column, hit: Column) -> Column:
        pos, weight = hit["pos"], hit["weight"]
        boost = F.when(s["boosted"] == pos, s["boost"]).otherwise(1.0)
        flipped = s["open"] >= pos
        value = weight * boost * F.when(flipped, s["flip"]).otherwise(1.0)
        value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
        return (
            F.when(hit["kind"] == "negation",
                   state(s["total"], s["n"], s["negated"], pos + reach, weight, s["boost"], s["boosted"]))
            .when(hit["kind"] == "intensifier",
                  state(s["total"], s["n"], s["negated"], s["open"], s["flip"], weight, pos + 1))
            .otherwise(state(s["total"] + value, s["n"] + 1, s["negated"] + flipped.cast("long"), none, one, one, none))
        )

    def finish(s: Column) -> Column:
        mean = F.when(s["n"] > 0, s["total"] / s["n"]).otherwise(0.0)
        return F.struct(mean.alias("polarity"), s["n"].alias("hits"), s["negated"].alias("negated"))

    return F.aggregate(hits, begin, step, finish)
