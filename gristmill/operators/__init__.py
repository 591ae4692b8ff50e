"""Gristmill operators."""
