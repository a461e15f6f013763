"""The lenses: each a function from input DataFrames to a ranked DataFrame."""
