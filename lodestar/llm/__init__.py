"""Operators that a training-data pipeline needs beside the query engine.

Nothing outside this subpackage imports it; ``queries`` registers what it offers.
"""
