"""Declarations compared, patched, created and looked after."""
