"""Scalar statistics: Column expressions, and tail functions on numpy and math alone."""
