"""Corpus policy analytics as Spark jobs: plain functions from DataFrames to DataFrames."""
