"""Queries over tables, and the path compiler."""
