"""operators of the text retrieval engine."""
