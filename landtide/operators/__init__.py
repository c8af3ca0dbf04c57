"""Operators on pixel, product and polygon tables."""
