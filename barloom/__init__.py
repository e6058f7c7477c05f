"""Keyed time-series analytics on Spark: bars, indicators, scores and picks as DataFrame plans."""
