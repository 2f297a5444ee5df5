"""One label from several unreliable labellers, by Dawid and Skene's expectation-maximisation.

Each labeller has a confusion table (what it says where the truth is this), each label a share.  A
round computes from them how likely each label is for an item, and from that the tables anew.  Only
those tables reach the driver: a row for each labeller and label.  Items with the same votes are
alike, so the rounds run over the distinct vote patterns and their numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodstream.functions.scoring import LABELS
from moodstream.session import written

#: Labellers times labels that a round's expression holds.
MOST_CELLS = 5_000


@dataclass(frozen=True)
class LabelModel:
    """Shares of the labels, and ``confusion[labeller][said]``: its probability under each true label."""

    labels: tuple[str, ...]
    shares: tuple[float, ...]
    confusion: dict[str, dict[str, tuple[float, ...]]]

    def posterior(self, votes: Column) -> Column:
        """Probability of each label, in the order of ``labels``, from an array of (labeller, said)."""
        cells = [
            part for labeller, said in self.confusion.items() for label, row in said.items()
            for part in (F.lit(_cell(labeller, label)), F.array(*[F.lit(math.log(p)) for p in row]))
        ]
        logs = F.create_map(*cells) if cells else F.lit(None).cast("map<string,array<double>>")
        nothing = F.array(*[F.lit(0.0) for _ in self.labels])
        start = F.array(*[F.lit(math.log(share)) for share in self.shares])

        def add(total: Column, vote: Column) -> Column:
            row = F.try_element_at(logs, F.concat_ws("\t", vote["labeller"], vote["said"]))
            return F.zip_with(total, F.coalesce(row, nothing), lambda a, b: a + b)

        def shares(total: Column) -> Column:
            weights = F.transform(total, lambda x: F.exp(x - F.array_max(total)))
            return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda s, v: s + v))

        return F.aggregate(votes, start, add, shares)


def _cell(labeller: str, label: str) -> str:
    return f"{labeller}\t{label}"


def gathered(votes: DataFrame, key: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``(key, votes)`` from ``(key, labeller, label)``; a vote for no known label is none, a repeated one counts once."""
    known = votes.where(F.col("label").isin(*labels) & F.col("labeller").isNotNull())
    vote = F.struct(F.col("labeller"), F.col("label").alias("said"))
    return known.groupBy(key).agg(F.array_sort(F.collect_set(vote)).alias("votes"))


def fit(items: DataFrame, *, rounds: int = 10, smooth: float = 1.0, labels: tuple[str, ...] = LABELS) -> LabelModel:
    """The model of gathered votes; begins with the shares of the votes, adds ``smooth`` to every cell."""
    patterns = written(items.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "patterns")
    model = None
    for _ in range(rounds):
        if model is None:
            likely = F.array(*[_said(label) / F.size("votes") for label in labels])
        else:
            likely = model.posterior(F.col("votes"))
        weighed = patterns.select("votes", "n", likely.alias("p"))
        model = _maximised(weighed, smooth, labels)
    return model


def _said(label: str) -> Column:
    """How many of an item's votes are for a label."""
    return F.size(F.filter("votes", lambda vote: vote["said"] == label))


def _maximised(weighed: DataFrame, smooth: float, labels: tuple[str, ...]) -> LabelModel:
    sums = [F.sum(F.col("n") * F.col("p")[k]) for k in range(len(labels))]
    whole = weighed.agg(*[F.coalesce(s, F.lit(0.0)) for s in sums]).first()
    votes = weighed.select("n", "p", F.explode("votes").alias("vote")).select("n", "p", "vote.*")
    rows = votes.groupBy("labeller", "said").agg(*sums).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"{len(rows)} labellers times labels; at most {MOST_CELLS}")
    seen: dict[str, dict[str, tuple[float, ...]]] = {}
    for labeller, said, *row in rows:
        seen.setdefault(labeller, {})[said] = tuple(row)
    confusion = {}
    for labeller in sorted(seen):
        cells = {said: seen[labeller].get(said, (0.0,) * len(labels)) for said in labels}
        totals = [math.fsum(cells[said][k] for said in labels) + smooth * len(labels) for k in range(len(labels))]
        confusion[labeller] = {
            said: tuple((cells[said][k] + smooth) / totals[k] for k in range(len(labels))) for said in labels
        }
    all_ = math.fsum(whole) + smooth * len(labels)
    return LabelModel(tuple(labels), tuple((w + smooth) / all_ for w in whole), confusion)


def combined(items: DataFrame, model: LabelModel) -> DataFrame:
    """Items with ``label`` (the first of the likeliest), ``confidence`` and ``probabilities`` by label."""
    likely = items.withColumn("_p", model.posterior(F.col("votes")))
    names = F.array(*[F.lit(label) for label in model.labels])
    best = F.array_max("_p")
    return likely.withColumns({
        "label": F.element_at(names, F.array_position("_p", best).cast("int")),
        "confidence": best,
        "probabilities": F.map_from_arrays(names, F.col("_p")),
    }).drop("_p")
