"""Taxonomy construction, vocabulary normalization and semantic retrieval on Spark DataFrames."""
