"""sources of lexispark."""
