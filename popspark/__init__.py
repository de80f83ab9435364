"""Windowed population-genomics analytics on Spark DataFrames."""
