"""Whole jobs: analysis of texts, served answers, and the registered table queries."""
