"""Spark-native analytics for recurring business reports.

A scenario is compiled to lazy DataFrames; Catalyst and adaptive execution choose the physical plan.
"""
