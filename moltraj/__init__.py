"""Trajectory analytics on Spark DataFrames."""
