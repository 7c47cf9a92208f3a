"""operators of lexispark."""
