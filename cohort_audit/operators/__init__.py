"""Audit operators: each takes a scored DataFrame and returns a tidy DataFrame."""
