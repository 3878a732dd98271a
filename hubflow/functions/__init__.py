"""hubflow.functions."""
