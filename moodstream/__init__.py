"""Sentiment analytics over short social posts, written as Spark DataFrame jobs."""
