"""Structured Streaming monitor of the additive statistics."""
