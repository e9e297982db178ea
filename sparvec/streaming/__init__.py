"""Incremental changes by micro-batches."""
