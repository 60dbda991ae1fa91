"""Exact pattern search over sequence collections, and corpus preparation, on PySpark."""
