"""Input that arrives in chunks."""
