"""Batch analytics over source-repository facts, expressed as PySpark DataFrame plans."""
