"""Artifacts of an audit: JSON, HTML, Markdown, XML and figure data."""
