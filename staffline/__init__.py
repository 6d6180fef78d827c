"""Leveling-survey analytics on PySpark DataFrames."""
