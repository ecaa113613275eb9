"""Window summaries from streams."""
