"""Operators: every function takes and returns DataFrames; `now` and the time zone are always parameters."""
