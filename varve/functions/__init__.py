"""Byte-level functions as Column expressions."""
