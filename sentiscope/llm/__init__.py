"""Operators of a training-data pipeline over documents, benchmark and page tables."""
