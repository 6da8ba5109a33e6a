"""Numeric kernels on numpy batches; nothing here imports Spark."""
