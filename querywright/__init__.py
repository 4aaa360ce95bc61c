"""Declarative, dictionary-shaped analytics queries lowered to lazy Spark plans."""
