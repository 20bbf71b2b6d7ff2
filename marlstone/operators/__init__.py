"""Transformations of keyed, ordered series."""
