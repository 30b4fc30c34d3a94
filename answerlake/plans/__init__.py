"""Whole lookups composed from the operators."""
