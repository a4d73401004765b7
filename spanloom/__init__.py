"""Interval, track and sequence analytics on Spark DataFrames."""
