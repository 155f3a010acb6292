"""plans of the text retrieval engine."""
