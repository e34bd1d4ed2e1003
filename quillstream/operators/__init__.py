"""Relational operators: DataFrames in, DataFrames out, keyed by question (qid)."""
