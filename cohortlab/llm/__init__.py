"""Corpus operators for training-data pipelines: one module per operator, `queries` binds them to tables."""
