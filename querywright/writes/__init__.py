"""Writes: whole-set changes of rows, checked and completed column by column."""
