"""Masking functions on columns, and the small row functions that Arrow tasks call."""
