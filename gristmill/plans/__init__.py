"""Gristmill plans."""
