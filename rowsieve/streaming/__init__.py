"""Validation of tables that arrive piece by piece."""
