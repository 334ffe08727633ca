"""Spark-native operators for cleaning, profiling, answering and scoring tabular data.

Every operator takes DataFrames and returns DataFrames (or builds Columns), so
Catalyst sees one declarative plan and the caller decides when to run it.
"""
