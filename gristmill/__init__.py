"""Gristmill: code-search, review and usage analytics as PySpark plans."""
