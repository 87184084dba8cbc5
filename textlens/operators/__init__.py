"""Operators: plain functions from DataFrames to DataFrames."""
