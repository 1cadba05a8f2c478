"""Operators: functions from DataFrames to DataFrames, one for each step of a check."""
