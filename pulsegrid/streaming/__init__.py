"""Structured Streaming versions of the causal operators."""
