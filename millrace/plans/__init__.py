"""Choosing which stored summary can answer a question."""
