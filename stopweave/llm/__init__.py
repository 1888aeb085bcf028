"""Operators of a training-data pipeline: every one takes and returns DataFrames."""
