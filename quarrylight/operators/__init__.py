"""Relational, graph and similarity operators over DataFrames."""
