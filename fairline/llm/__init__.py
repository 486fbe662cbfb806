"""Operators of a training-data pipeline, each by one named method; nothing else in the library imports them."""
