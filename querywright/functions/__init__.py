"""Scalar functions and casts with the semantics that specifications expect."""
