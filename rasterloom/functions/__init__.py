"""Per-sample column functions."""
