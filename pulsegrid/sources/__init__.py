"""Readers, writers and the catalogue of batches."""
