"""Weighs and explains dependency graphs with PySpark."""
