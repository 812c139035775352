"""Expressions and conversions."""
