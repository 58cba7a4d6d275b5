"""Analytic operators: functions from tables (DataFrames) to a DataFrame."""
