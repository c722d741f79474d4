"""Operators for preparing training data: text, pages and benchmark tables in, DataFrames out."""
