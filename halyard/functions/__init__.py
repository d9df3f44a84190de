"""Scalar functions over vector, code and sparse columns."""
