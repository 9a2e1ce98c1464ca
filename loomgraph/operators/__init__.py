"""Operators: functions from DataFrames and parameters to lazy DataFrames."""
