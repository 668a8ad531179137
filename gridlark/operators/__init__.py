"""Operators on DataFrames: filters, search, sorting, aggregation, pivots, profiles, statistics."""
