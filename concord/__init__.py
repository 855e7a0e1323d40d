"""Exhaustive, multi-source label validation on Spark tables."""
