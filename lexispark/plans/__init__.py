"""plans of lexispark."""
