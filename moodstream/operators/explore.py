"""N-grams, keywords, word clouds and topic models over post texts."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodstream.functions.text import histogram, ngrams, topic_tokens
from moodstream.functions.wordlists import stop_words
from moodstream.operators.topic_model import fit_topics
from moodstream.operators.topics import word_rows
from moodstream.session import written

#: A word of more than one post in so many is common.
COMMON = 200


def ngram_counts(posts: DataFrame, longest: int = 3, *, text: str = "text") -> DataFrame:
    """Occurrences of every run of 1 … ``longest`` topic words; runs never cross posts."""
    words = posts.select(topic_tokens(text, stop_words()).alias("_words"))
    runs = F.concat(*[ngrams("_words", n) for n in range(1, longest + 1)])
    counts = words.select(F.explode(runs).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.size(F.split("ngram", " ")).alias("n"), "ngram", "count")


def tfidf_keywords(posts: DataFrame, k: int = 5, *, key: str = "id", text: str = "text") -> DataFrame:
    """The ``k`` words of each post with the highest ``tf * ln((N + 1) / (df + 1))``.

    Words are counted inside each post's row, once; only the document frequencies are grouped.
    Words of more than one post in ``COMMON`` are few however many posts there are (their number is
    bounded by the words of a post), so they meet their frequency by a broadcast; only the rows of
    the others are shuffled by word, and none of those is hot.
    """
    counted = F.explode(histogram(topic_tokens(text, stop_words()))).alias("_c")
    term_counts = written(posts.select(key, counted).select(key, "_c.word", F.col("_c.n").alias("tf")), "terms")
    documents = posts.agg(F.count(F.lit(1))).scalar()
    frequency = term_counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarity = F.log((documents + 1) / (F.col("df") + 1))
    frequency = frequency.select("word", "df", rarity.alias("rarity"), (F.col("df") * COMMON > documents).alias("common"))
    frequency = written(frequency, "frequencies")
    common = frequency.where("common")
    by_word = term_counts.join(F.broadcast(common.select("word")), "word", "left_anti").join(frequency.where("not common"), "word")
    # Rounding first keeps ties exact, so the order does not hang on the last digit.
    weighted = term_counts.join(F.broadcast(common), "word").unionByName(by_word).select(
        key, "word", "tf", "df", F.round(F.col("tf") * F.col("rarity"), 6).alias("tfidf")
    )
    best = Window.partitionBy(key).orderBy(F.desc("tfidf"), "word")
    return weighted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def word_cloud(posts: DataFrame, n: int = 50, *, text: str = "text") -> DataFrame:
    """The ``n`` most frequent topic words with their weight relative to the first."""
    counts = word_rows(posts, text=text).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    shown = counts.orderBy(F.desc("count"), "word").limit(n)
    largest = F.max("count").over(Window.partitionBy(F.lit(0)))
    return shown.withColumn("weight", F.col("count") / largest)


def lda_topics(
    posts: DataFrame,
    topics: int = 5,
    terms: int = 10,
    *,
    vocabulary: int | None = None,
    iterations: int = 20,
    seed: int = 42,
    text: str = "text",
) -> DataFrame:
    """``topic, rank, term, weight`` of a latent topic model over topic words.

    Every step of the fit sees all posts and every word of at least two posts, as counted first; the
    driver holds these words, their weights stay on the executors.  ``vocabulary`` keeps the most
    frequent ones only.
    """
    # Cutting the texts costs more than reading their words again.
    words = written(posts.select(topic_tokens(text, stop_words()).alias("_words")), "words")
    if vocabulary is None:
        held = words.select(F.explode(F.array_distinct("_words")).alias("word")).groupBy("word").count()
        vocabulary = max(1, held.where("count >= 2").count())
    counter = CountVectorizer(inputCol="_words", outputCol="features", vocabSize=vocabulary, minDF=2).fit(words)
    names = counter.vocabulary
    counted = counter.transform(words).select(F.unwrap_udt("features").alias("_f"))
    counted = counted.select(F.col("_f.indices").alias("words"), F.col("_f.values").alias("n"))
    best = Window.partitionBy("topic").orderBy(F.desc("weight"), "word")
    ranked = fit_topics(counted, len(names), topics, iterations, seed).withColumn("rank", F.row_number().over(best))
    ranked = written(ranked.where(F.col("rank") <= terms), "topic-terms")
    shown = [row.word for row in ranked.select("word").distinct().collect()]  # terms of each topic
    listed = posts.sparkSession.createDataFrame([(i, names[i]) for i in shown], "word int, term string")
    return ranked.join(F.broadcast(listed), "word").select("topic", "rank", "term", "weight")
