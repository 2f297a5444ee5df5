"""Explicit schemas, so no read infers one and no batch can drift."""

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
LINE = "_line"

EVENT = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("did", T.StringType()),
    T.StructField("time_us", T.LongType()),
    T.StructField("commit", T.StructType([
        T.StructField("operation", T.StringType()),
        T.StructField("rkey", T.StringType()),
        T.StructField("record", T.StructType([
            T.StructField("langs", T.ArrayType(T.StringType())),
            T.StructField("text", T.StringType()),
            T.StructField("createdAt", T.StringType()),
        ])),
    ])),
])

EVENT_OR_CORRUPT = T.StructType(EVENT.fields + [T.StructField(CORRUPT, T.StringType())])

POST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("did", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("created_at", T.StringType()),
])

POST_OR_CORRUPT = T.StructType(POST.fields + [T.StructField(CORRUPT, T.StringType())])

SENTIMENT = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

SCORED = T.StructType(
    POST.fields + [T.StructField("sentiment", SENTIMENT), T.StructField("date", T.StringType())]
)

COLD = T.StructType(SCORED.fields + [T.StructField("batch_id", T.LongType())])

# Partials kept by the streaming state: sums and counts, never averages or percentages.
LABEL_PARTS = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("batch_id", T.LongType()),
])

TREND_PARTS = T.StructType([
    T.StructField("bucket", T.LongType()),
    T.StructField("sum_score", T.DoubleType()),
    T.StructField("n", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])

TOPIC_PARTS = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("batch_id", T.LongType()),
])

POST_PARTS = T.StructType([
    T.StructField("did", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("sentiment", SENTIMENT),
    T.StructField("created_at", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])

TOPIC_SKETCH = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("low", T.LongType()),
    T.StructField("error", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("batch_id", T.LongType()),
])

QUARANTINE = T.StructType([
    T.StructField("reason", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])

MANIFEST = T.StructType([
    T.StructField("posts", T.LongType()),
    T.StructField("committed_at", T.TimestampType()),
    T.StructField("batch_id", T.LongType()),
])

SEEN = T.StructType([
    T.StructField("did", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])

SEEN_BITS = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("bucket", T.LongType()),
    T.StructField("bits", T.BinaryType()),
    T.StructField("batch_id", T.LongType()),
])
