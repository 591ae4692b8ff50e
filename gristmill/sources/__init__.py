"""Gristmill sources."""
