"""Operators on DataFrames: series, space, graphs, features, metrics, message passing."""
