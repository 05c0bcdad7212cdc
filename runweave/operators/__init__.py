"""Operators on run grids."""
