"""Similarity-based flexible query answering on Spark, with training-data operators beside it."""
