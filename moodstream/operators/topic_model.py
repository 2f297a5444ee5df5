"""A latent topic model whose weights stay on the executors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodstream.session import written

#: Words of posts (each once a post) that one call infers the topics of.
BLOCK = 1 << 18
#: Of these, so many are refined at once: few enough for a core's cache.
AT_ONCE = 1 << 15
#: Words of the vocabulary whose weights lie together.
PART = 1 << 14
#: Step ``i`` replaces ``(OFFSET + i) ** -DECAY`` of the weights, as Spark's online fit has it by default.
OFFSET, DECAY = 1024.0, 0.51
#: Weights and mixtures begin as draws around 1; a post's mixture is found once it moves by less than this.
SHAPE, STILL = 100.0, 1e-3
#: Passes of a round; leaps begin after so many passes and end after so many, since passes alone cannot circle;
#: moves that a leap is long at most.
ROUND, PASSES, LEAPT, FARTHEST = 16, 96, 4000, 64.0


def fit_topics(counts: DataFrame, words: int, topics: int, iterations: int, seed: int) -> DataFrame:
    """``word, topic, weight`` of a topic model over ``counts`` (``words array<int>, n array<double>``).

    Variational Bayes with learned concentrations of the posts, as Spark's online fit.  Each step infers the
    mixtures of all posts, block by block: the parts of the vocabulary send a block the weights of its own
    words alone, and what it finds goes back to them.  Both travel as packed numbers, a row for each block and
    part.  Only sums by topic reach the driver.
    """
    names = [f"t{i}" for i in range(topics)]
    posts = counts.where(F.size("words") > 0).withColumn("row", F.monotonically_increasing_id())
    posts = written(posts, "word-counts")
    size = posts.agg(F.count(F.lit(1)).alias("posts"), F.sum(F.size("words")).alias("pairs")).first()
    if not iterations or not size.posts:
        raise ValueError("a topic model needs a step and a post with words")
    parts = math.ceil(words / PART)
    block = F.pmod(F.xxhash64("row"), F.lit(math.ceil(size.pairs / BLOCK))).cast("int")
    packed = posts.select(block.alias("block"), "words", "n").groupBy("block")
    packed = written(packed.applyInArrow(_packed_posts(parts), POSTS), "blocks")
    posts = packed.where("part IS NULL").select("block", "at", "n", "lengths")
    meets = packed.where("part IS NOT NULL").select("block", "part", "words")
    first = _first_weights(posts.sparkSession.range(words), names, seed)
    first = first.groupBy(F.pmod("word", F.lit(parts)).alias("part"))
    layout = ", ".join(["part int, weights binary", *[f"{c} double" for c in names]])
    weights = written(first.applyInArrow(_packed_weights(names), layout), "weights")
    total = _sums(weights, names)[False]
    alpha, eta = np.full(topics, 1.0 / topics), 1.0 / topics
    for step in range(1, iterations + 1):
        rate = (OFFSET + step) ** -DECAY
        infer = _inference(alpha, _digamma(total), _draws(seed, -step, topics), rate)
        own = weights.select("part", "weights")
        sent = own.groupBy("part").cogroup(meets.groupBy("part")).applyInArrow(_sending(topics, parts), SENT)
        found = posts.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(infer, SENT)
        held = own.select("part", F.lit(None).cast("int").alias("block"), F.lit(None).cast("binary").alias("words"), "weights")
        held = held.unionByName(meets, allowMissingColumns=True).groupBy("part")
        summed = found.groupBy("part").cogroup(held).applyInArrow(_summing(names, parts, rate, eta), layout)
        summed = written(summed, "weights")
        sums = _sums(summed, names)
        total, alpha = sums[False], _moved(alpha, sums[True] / size.posts, size.posts, rate)
        weights = summed.where("part >= 0")
    unpacked = weights.mapInArrow(_unpacked_weights(names, parts), _row_layout(names))
    shares = F.array(*[F.col(c) / float(t) for c, t in zip(names, total, strict=True)])
    return unpacked.select("word", F.posexplode(shares).alias("topic", "weight"))


#: A block's posts (``part`` is null) and its words of each part; numbers are packed, ``at`` counts through those words.
POSTS = "block int, part int, words binary, at binary, n binary, lengths binary"
#: Weights that a part has for a block's words, or what the block adds to them; what concerns no word has part -1.
SENT = "block int, part int, weights binary"


def _row_layout(names: list[str]) -> str:
    return ", ".join(["word int", *[f"{c} double" for c in names]])


def _sums(weights: DataFrame, names: list[str]) -> dict[bool, np.ndarray]:
    """Sums by topic: of all words, and of the posts' own row, whose part is -1."""
    rows = weights.groupBy((F.col("part") < 0).alias("own")).agg(*[F.sum(c).alias(c) for c in names]).collect()
    return {row.own: np.array([row[c] for c in names]) for row in rows}


def _numbers(column, at: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(column[at].as_buffer(), kind)


def _packed_posts(parts):
    def pack(key: tuple[pa.Scalar, ...], posts: pa.Table) -> pa.Table:
        words, at = np.unique(pc.list_flatten(posts["words"]).to_numpy(), return_inverse=True)
        order = np.argsort(words % parts, kind="stable")
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words))
        words = words[order].astype(np.int32)
        own, starts = np.unique(words % parts, return_index=True)
        block, nothing = key[0].as_py(), [None] * len(own)
        n = pc.list_flatten(posts["n"]).to_numpy().astype(np.float64)
        lengths = pc.list_value_length(posts["words"]).to_numpy().astype(np.int32)
        return pa.table({
            "block": pa.array([block] * (len(own) + 1), pa.int32()),
            "part": pa.array([None, *own.tolist()], pa.int32()),
            "words": pa.array([None, *[w.tobytes() for w in np.split(words, starts[1:])]], pa.binary()),
            **{
                name: pa.array([values.tobytes(), *nothing], pa.binary())
                for name, values in (("at", place[at]), ("n", n), ("lengths", lengths))
            },
        })

    return pack


def _weight_rows(names, part, weights):
    sums = {c: pa.array([s]) for c, s in zip(names, weights.sum(axis=1), strict=True)}
    return pa.table({"part": pa.array([part], pa.int32()), "weights": pa.array([weights.tobytes()], pa.binary()), **sums})


def _packed_weights(names):
    def pack(key: tuple[pa.Scalar, ...], weights: pa.Table) -> pa.Table:
        order = np.argsort(weights["word"].to_numpy())
        return _weight_rows(names, key[0].as_py(), np.stack([weights[c].to_numpy()[order] for c in names]))

    return pack


def _unpacked_weights(names, parts):
    def unpack(batches):
        for batch in batches:
            for i, part in enumerate(batch["part"].to_pylist()):
                weights = _numbers(batch["weights"], i).reshape(len(names), -1)
                words = np.arange(weights.shape[1], dtype=np.int32) * parts + part
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), *map(pa.array, weights)], ["word", *names])

    return unpack


def _sent(blocks, parts, weights) -> pa.Table:
    columns = [pa.array(blocks, pa.int32()), pa.array(parts, pa.int32()), pa.array(weights, pa.binary())]
    return pa.table(columns, ["block", "part", "weights"])


def _sending(topics, parts):
    """The weights of a part that each block asks for."""

    def send(weights: pa.Table, meets: pa.Table) -> pa.Table:
        own = _numbers(weights["weights"], 0).reshape(topics, -1)
        asked = [_numbers(meets["words"], i, np.int32) // parts for i in range(len(meets))]
        return _sent(meets["block"].to_pylist(), meets["part"].to_pylist(), [own[:, words].tobytes() for words in asked])

    return send


def _summing(names, parts, rate, eta):
    """The new weights of a part, from the old ones and what the blocks add."""

    def add(found: pa.Table, held: pa.Table) -> pa.Table:
        added = sorted((block, i) for i, block in enumerate(found["block"].to_pylist()))
        if not len(held):
            values = np.stack([_numbers(found["weights"], i) for _, i in added])
            return _weight_rows(names, -1, values.sum(axis=0)[:, None])
        rows = {block: i for i, block in enumerate(held["block"].to_pylist())}
        weights = _numbers(held["weights"], rows[None]).reshape(len(names), -1) * (1 - rate) + rate * eta
        for block, i in added:
            words = _numbers(held["words"], rows[block], np.int32) // parts
            weights[:, words] += _numbers(found["weights"], i).reshape(len(names), -1)
        return _weight_rows(names, held["part"][0].as_py(), weights)

    return add


def _draws(seed: int, at: int, *shape: int) -> np.ndarray:
    return np.random.default_rng([seed % 2**63, at % 2**63]).gamma(SHAPE, 1 / SHAPE, shape)


def _first_weights(words: DataFrame, names: list[str], seed: int) -> DataFrame:
    def drawn(batches):
        for batch in batches:
            ids = batch["id"].to_numpy()
            if len(ids):
                columns = [pa.array(c) for c in _draws(seed, int(ids[0]), len(names), len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *columns], ["word", *names])

    return words.mapInArrow(drawn, _row_layout(names))


def _inference(alpha, spread, first, rate):
    """The step of one block: what its posts add to the weights of its words, and as part -1 the sum
    of their expected log mixtures."""

    def infer(posts: pa.Table, weights: pa.Table) -> pa.Table:
        parts = weights["part"].to_numpy()
        order = np.argsort(parts)
        own = [_numbers(weights["weights"], int(i)).reshape(len(alpha), -1) for i in order]
        beta = np.exp(_digamma(np.hstack(own)) - spread[:, None])
        at, lengths = (_numbers(posts[c], 0, np.int32) for c in ("at", "lengths"))
        n = _numbers(posts["n"], 0)
        logs = _expected_logs(_mixtures(beta, at, n, lengths, alpha, first).T)
        theta = np.repeat(np.exp(logs), lengths, axis=1)
        share = n / ((theta * beta[:, at]).sum(axis=0) + 1e-100)
        words = beta.shape[1]
        added = np.stack([np.bincount(at, t * share, words) * b * rate for t, b in zip(theta, beta, strict=True)])
        cuts = np.cumsum([o.shape[1] for o in own])[:-1]
        rows = [logs.sum(axis=1), *np.split(added, cuts, axis=1)]
        return _sent([posts["block"][0].as_py()] * len(rows), [-1, *parts[order].tolist()], [r.tobytes() for r in rows])

    return infer


def _mixtures(beta, at, n, lengths, alpha, first):
    """Posts by topics: each post's mixture, refined until a pass moves it by less than ``STILL``.

    ``at`` (columns of ``beta``) and ``n`` hold the words of one post after the other.  Passes creep
    where topics are alike, so a post that moves after ``PASSES`` of them leaps on along the way it went
    after every two (Varadhan and Roland's SQUAREM).  What is found is always what a pass gave.
    """
    starts, live, done = np.cumsum(lengths) - lengths, np.arange(len(lengths)), 0
    gamma = np.repeat(first[None], len(lengths), axis=0)
    while len(live):
        leaps, left = PASSES <= done < LEAPT, []
        for ids in _alike(live, lengths):
            place = np.arange(lengths[ids].max())
            real = place < lengths[ids][:, None]
            places = np.where(real, starts[ids][:, None] + place, 0)
            own = np.ascontiguousarray(beta[:, at[places]].transpose(1, 0, 2))
            gamma[ids], moving = _refined(gamma[ids], own, np.where(real, n[places], 0.0), alpha, leaps)
            left.append(ids[moving])
        live, done = np.concatenate(left), done + ROUND
    return gamma


def _alike(live, lengths):
    """Posts of like length, of ``AT_ONCE`` words at most when filled up to the longest (or one post)."""
    order, done = live[np.argsort(-lengths[live], kind="stable")], 0
    while done < len(order):
        ids = order[done : done + max(1, AT_ONCE // lengths[order[done]])]
        yield ids
        done += len(ids)


def _refined(gamma, beta, n, alpha, leaps):
    """Mixtures after a round, and which of them still move; ``beta`` (posts by topics by words) and ``n`` (posts by
    words) may be filled up with words of number 0."""
    moving, found = np.ones(len(gamma), bool), gamma.copy()
    for _ in range(ROUND // 2):
        way = [gamma]
        for _ in range(2):
            way.append(_pass(beta, n, alpha, way[-1]))
            still = moving & ~(np.abs(way[-1] - way[-2]).mean(axis=1) > STILL)
            found[still] = way[-1][still]
            moving &= ~still
        gamma = _leap(*way, alpha) if leaps else way[2]
    return np.where(moving[:, None], gamma, found), moving


def _pass(beta, n, alpha, gamma):
    theta = np.exp(_expected_logs(gamma.T)).T
    share = n / (np.matmul(theta[:, None], beta)[:, 0] + 1e-100)
    return theta * np.matmul(beta, share[:, :, None])[:, :, 0] + alpha


def _leap(start, once, twice, alpha):
    """On from ``start``, by the ratio of the first move to what the second changed of it."""
    move = once - start
    bend = twice - once - move
    long = np.sqrt((move * move).sum(axis=1) / ((bend * bend).sum(axis=1) + 1e-300)).clip(1, FARTHEST)[:, None]
    return np.maximum(start + 2 * long * move + long * long * bend, alpha)


def _moved(alpha, logs, posts, rate):
    """Concentrations after a Newton step of ``rate`` towards the posts' mean expected log mixture."""
    slope = posts * (_digamma(alpha.sum()) - _digamma(alpha) + logs)
    whole, own = posts * _trigamma(alpha.sum()), -posts * _trigamma(alpha)
    shared = (slope / own).sum() / (1 / whole + (1 / own).sum())
    moved = alpha - rate * (slope - shared) / own
    return moved if (moved > 0).all() else alpha


def _expected_logs(gamma):
    both = _digamma(np.vstack([gamma, gamma.sum(axis=0)]))
    return both[:-1] - both[-1]


def _digamma(x):
    """Derivative of the log of the gamma function: six steps up, paired, then its series."""
    outer = x * (x + 5)
    up = (2 * x + 5) * (1 / outer + 1 / (outer + 4) + 1 / (outer + 6))
    x = x + 6
    r = 1 / (x * x)
    return np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - up


def _trigamma(x):
    up = sum(1 / (x + i) ** 2 for i in range(6))
    x = x + 6
    r = 1 / (x * x)
    return up + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))
