"""streaming of the text retrieval engine."""
