"""Composable queries."""
