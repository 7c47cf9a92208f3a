"""functions of lexispark."""
