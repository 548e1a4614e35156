"""Operators for building text training corpora, on DataFrames."""
