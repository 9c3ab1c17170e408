"""Exhaustive, exact enumeration of discrete state spaces with Spark DataFrames."""
