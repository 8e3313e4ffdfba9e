"""streaming of the corpus engine."""
