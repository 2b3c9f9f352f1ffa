"""Pairwise-Bayes analytics on Spark: DataFrame-first operators, sources and plans."""
