"""Operators of a training-data pipeline: each takes a documents DataFrame and returns a DataFrame."""
