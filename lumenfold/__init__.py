"""Lumenfold: content-aggregation analytics and training-data operators on Spark DataFrames."""
