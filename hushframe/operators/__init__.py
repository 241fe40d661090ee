"""Masking of whole DataFrames."""
