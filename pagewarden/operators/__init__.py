"""Operators of pagewarden."""
