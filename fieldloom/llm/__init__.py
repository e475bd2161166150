"""Operators for training-data pipelines over large document tables."""
