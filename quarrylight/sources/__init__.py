"""Ingestion of repository facts into DataFrames."""
