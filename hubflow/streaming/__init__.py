"""hubflow.streaming."""
