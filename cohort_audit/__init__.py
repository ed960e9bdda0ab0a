"""Fairness and performance audits of binary risk models, as Spark jobs."""
