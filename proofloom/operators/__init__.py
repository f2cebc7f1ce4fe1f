"""Operators over DataFrames; each module states its results for nulls, ties and empty input."""
