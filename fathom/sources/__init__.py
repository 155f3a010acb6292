"""sources of the text retrieval engine."""
