"""Scalar and array functions, as column expressions or Arrow batch programs."""
