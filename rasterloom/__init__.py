"""Raster-stack analytics on PySpark."""
