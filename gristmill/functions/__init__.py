"""Gristmill functions."""
