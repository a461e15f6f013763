"""Column functions and per-file extractors."""
