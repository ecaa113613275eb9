"""Windowed time-series summaries and large-corpus operators on Spark DataFrames."""
