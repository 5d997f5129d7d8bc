"""Curate, prepare, score and rank labelled text benchmarks with Spark DataFrames."""
