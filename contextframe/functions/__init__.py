"""Scalar functions as Column expressions that stay inside code generation."""
