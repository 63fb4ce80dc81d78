"""Whole paths built from the operators, and the catalogue of named queries."""
