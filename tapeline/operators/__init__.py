"""Operators on DataFrames of files, segments and log lines."""
