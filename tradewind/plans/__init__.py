"""Loads and reports composed from the operators."""
