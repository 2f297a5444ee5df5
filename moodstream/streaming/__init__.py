"""Structured Streaming jobs and the state they keep."""
