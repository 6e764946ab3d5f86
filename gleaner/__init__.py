"""Gleaner: fetch, explore and extract structured data from documents on Spark DataFrames."""
