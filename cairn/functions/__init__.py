"""Scalar functions and model formulas."""
