"""Operators on DataFrames: joins, tracks, grids, detection, metrics, classification."""
