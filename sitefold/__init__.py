"""Spark-native table operators for quantitative proteomics-style data.

Every operator takes and returns DataFrames and takes its column names as
parameters.  See README.md for the design rules.
"""
