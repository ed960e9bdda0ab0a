"""Training-data operators: one module per operator, queries in :mod:`cohort_audit.llm.queries`."""
