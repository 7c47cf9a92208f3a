"""streaming of lexispark."""
