"""Comparison, logical and arithmetic operators of the specification language."""
