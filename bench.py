"""Time the headline queries on ``$BENCH_SF_DIR``; prints one JSON line.

Every query runs to the end into a sink that keeps nothing: once to warm up, then once to be timed
(the median, should ``RUNS`` be more).  The forest and the topic model are left out: they time the ML library.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from moodstream.plans.table_queries import QUERIES
from moodstream.session import build_session

HEADLINE = """
ingest_events clean_text word_tokens keyword_sentiment polarity_lexicon ensemble_vote analyze_posts
label_distribution stats_cumulative trend_minute trend_hour trend_merge trends_period trend_rolling
recent_posts topic_counts topics_dedup ngram_counts tfidf_keywords jsonl_roundtrip cold_history
stream_ingest stream_totals stream_dedup model_scorer
""".split()
RUNS = 1


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    timings = {}
    for name in HEADLINE:
        run(name)
        timings[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "headline queries, sum of seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": Path(folder).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
