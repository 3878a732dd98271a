"""hubflow.sources."""
