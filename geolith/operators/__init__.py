"""Operators: functions from DataFrames and plain arguments to DataFrames."""
