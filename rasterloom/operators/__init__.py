"""Raster operators: DataFrame to DataFrame."""
