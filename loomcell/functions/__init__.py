"""Scalar functions: Column builders and Arrow helpers."""
