"""Operators of a training-data pipeline: tokens, duplicates, filters and checks of large text tables."""
