"""Operators over samples and results, each a composition of DataFrame operations."""
