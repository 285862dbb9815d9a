"""Compositions of operators that build whole tables."""
