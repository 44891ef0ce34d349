"""Corpus, vocabulary and benchmark-data operators on Spark DataFrames."""
