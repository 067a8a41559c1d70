"""Operators of a training-data pipeline: packing, filters, dedup, classifiers, search."""
