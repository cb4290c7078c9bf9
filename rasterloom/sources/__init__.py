"""Where rasters come from."""
