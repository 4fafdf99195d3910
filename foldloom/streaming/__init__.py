"""Fold results as they arrive."""
