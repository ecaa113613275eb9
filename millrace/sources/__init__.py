"""Reading samples, and tables of window summaries."""
