"""Scalar expressions and distributions."""
