"""Mobility and place-inference jobs on Spark DataFrames."""
