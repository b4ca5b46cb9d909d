"""Scalar and aggregate expressions."""
