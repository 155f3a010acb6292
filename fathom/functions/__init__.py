"""functions of the text retrieval engine."""
