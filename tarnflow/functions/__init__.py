"""Declared field types and the casts from raw text to them, as Column expressions."""
