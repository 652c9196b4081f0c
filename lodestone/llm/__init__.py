"""Operators for training-data pipelines over whole-text document tables.

Nothing outside this package imports it; each module holds one operator with its query beside it."""
