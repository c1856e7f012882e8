"""Operators for training-data pipelines; optional sub-package."""
