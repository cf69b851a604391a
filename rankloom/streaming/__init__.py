"""Continuous intake of hit tables."""
