"""Imports of source files."""
