"""Queries of the library, built from the operators."""
