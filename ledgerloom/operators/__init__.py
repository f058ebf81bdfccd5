"""Stages of a reconciliation, each a function from DataFrames to DataFrames."""
