"""Operators of a training-data pipeline, each built on Spark; nothing else in the library imports them."""
