"""Gristmill streaming."""
