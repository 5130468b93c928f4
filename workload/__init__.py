"""The queries registered for checking and timing, over the given tables."""
