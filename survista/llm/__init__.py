"""Corpus operators for training-data pipelines, apart from the mortality engine."""
