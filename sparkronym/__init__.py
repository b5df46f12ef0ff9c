"""Acronym analytics and data preparation on Spark DataFrames."""
