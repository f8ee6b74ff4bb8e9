"""Spark-first correlation clustering over DataFrames."""
