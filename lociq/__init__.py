"""Interval analytics for long-read structural variants, expressed as Spark DataFrames."""
